"""Voting, stacking, blending and multi-level ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import q
from ..session import cut_lineage
from .models import all_scores, cached, fit_model
from .split import mark_folds, train_test_split

Base = tuple[str, str, dict[str, Any]]  # (name, model, params)


# ---- combining columns ------------------------------------------------------------


def soft_vote(probabilities: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of probability arrays."""
    weights = list(weights or [1.0] * len(probabilities))
    total = sum(weights)

    def scale(p: str, share: float) -> Column:
        return F.transform(q(p), lambda x: x * F.lit(share))

    scaled = [scale(p, w / total) for p, w in zip(probabilities, weights)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), scaled)


def top_class(probability: Column) -> Column:
    """Position of the largest entry; the first on ties."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("double")


def hard_vote(predictions: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted majority; the smallest class on ties."""
    weights = list(weights or [1.0] * len(predictions))
    cast = [q(p).cast("double") for p in predictions]

    def votes(c: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.when(p == c, F.lit(float(w))).otherwise(0.0) for p, w in zip(cast, weights)])

    ballots = F.array(*[F.struct((-votes(c)).alias("v"), c.alias("c")) for c in cast])
    return F.array_min(ballots)["c"]


def mean_vote(predictions: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights or [1.0] * len(predictions))
    return reduce(lambda a, b: a + b, [q(p) * F.lit(w / sum(weights)) for p, w in zip(predictions, weights)])


# ---- fitted ensembles --------------------------------------------------------------


def _chain(models: dict[str, Any], df: DataFrame, task: str) -> DataFrame:
    """All base predictions as columns of one frame, by successive transforms."""
    out = df
    for name, m in models.items():
        out = m.transform(out).withColumnRenamed("prediction", f"_p_{name}")
        if task == "classification":
            out = out.withColumnRenamed("probability", f"_q_{name}")
    return out


def _meta_columns(names: Sequence[str], task: str, classes: int) -> dict[str, Column]:
    """Meta features: the positive probability, all probabilities, or the value."""
    out: dict[str, Column] = {}
    for n in names:
        if task == "regression":
            out[f"_m_{n}"] = F.col(f"_p_{n}")
        elif classes == 2:
            out[f"_m_{n}"] = F.get(F.col(f"_q_{n}"), F.lit(1))
        else:
            for k in range(classes):
                out[f"_m_{n}_{k}"] = F.get(F.col(f"_q_{n}"), F.lit(k))
    return out


def _class_count(df: DataFrame, label: str, task: str) -> int:
    return int(df.agg(F.max(q(label))).first()[0]) + 1 if task == "classification" else 0


@dataclass
class Voting:
    models: dict[str, Any]
    task: str
    voting: str = "soft"
    weights: list[float] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        out = _chain(self.models, df, self.task)
        ps = [f"_p_{n}" for n in self.models]
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        if self.task == "regression":
            return out.select(*kept, mean_vote(ps, self.weights).alias("prediction"))
        mixed = out.withColumn("probability", soft_vote([f"_q_{n}" for n in self.models], self.weights))
        pick = top_class(F.col("probability")) if self.voting == "soft" else hard_vote(ps, self.weights)
        return mixed.select(*kept, pick.alias("prediction"), "probability")


@dataclass
class Stacked:
    """Base models, then a meta model on their outputs (and the features, if
    passed through)."""

    models: dict[str, Any]
    meta: Any
    task: str
    classes: int
    extra: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        out = _chain(self.models, df, self.task).withColumns(_meta_columns(list(self.models), self.task, self.classes))
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        done = self.meta.transform(out)
        cols = ["prediction"] + (["probability"] if self.task == "classification" else [])
        return done.select(*kept, *cols)


def fit_voting(df, bases: Sequence[Base], features, label, task, voting="soft", weights=None, key=None) -> Voting:
    with cached(df) as ready:
        models = _fit_bases(ready, bases, features, label, task, key)
    return Voting(models, task, voting, weights)


def _fit_bases(df, bases: Sequence[Base], features, label, task, key, parallelism: int = 4) -> dict[str, Any]:
    return dict(zip([b[0] for b in bases], _fit_each([(df, m, features, label, task, p, key) for _, m, p in bases], parallelism)))


def _fit_each(fits: Sequence[tuple], parallelism: int) -> list:
    """Models of (df, model, features, label, task, params, key); a bounded number at a time, because their small jobs overlap."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(lambda fit: fit_model(*fit), fits))


def out_of_fold(df, bases: Sequence[Base], features, label, task, key, folds=5, seed=42, parallelism=4) -> DataFrame:
    """Every row with base predictions from models that did not see it."""
    ready = cut_lineage(mark_folds(df, key, folds, seed, label if task == "classification" else None))
    train = [ready.where(F.col("fold") != f) for f in range(folds)]
    fitted = _fit_each([(t, m, features, label, task, p, key) for t in train for _, m, p in bases], parallelism)
    parts = []
    for f in range(folds):
        models = {base[0]: model for base, model in zip(bases, fitted[f * len(bases) :])}
        parts.append(_chain(models, ready.where(F.col("fold") == f), task))
    return reduce(DataFrame.unionByName, parts)


def _meta_name(task: str) -> str:
    return "logistic_regression" if task == "classification" else "ridge"


def fit_stacking(
    df, bases: Sequence[Base], features, label, task, key, folds=5, passthrough=False, meta: str | None = None, seed=42
) -> Stacked:
    classes = _class_count(df, label, task)
    with cached(df) as ready:
        rows = out_of_fold(ready, bases, features, label, task, key, folds, seed)
        made = _meta_columns([b[0] for b in bases], task, classes)
        extra = list(features) if passthrough else []
        with cached(rows.withColumns(made).select(q(label), *made, *[q(c) for c in extra])) as level:
            meta_model = fit_model(level, meta or _meta_name(task), [*made, *extra], label, task)
        models = _fit_bases(ready, bases, features, label, task, key)
    return Stacked(models, meta_model, task, classes, extra)


def fit_blending(
    df, bases: Sequence[Base], features, label, task, key, holdout=0.2, meta: str | None = None, seed=42
) -> Stacked:
    """Base models on one part, the meta model on their predictions of the other."""
    classes = _class_count(df, label, task)
    train, held = train_test_split(df, key, holdout, seed, label if task == "classification" else None)
    with cached(train) as ready:
        models = _fit_bases(ready, bases, features, label, task, key)
    made = _meta_columns([b[0] for b in bases], task, classes)
    level = _chain(models, held, task).withColumns(made)
    return Stacked(models, fit_model(level, meta or _meta_name(task), list(made), label, task), task, classes)


@dataclass
class MultiLevel:
    levels: list[dict[str, Any]]
    final: Any
    task: str
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        out = df
        for models in self.levels:
            out = _chain(models, out, self.task).withColumns(_meta_columns(list(models), self.task, self.classes))
        done = self.final.transform(out)
        cols = ["prediction"] + (["probability"] if self.task == "classification" else [])
        return done.select(*kept, *cols)


def fit_multi_level(df, levels: Sequence[Sequence[Base]], features, label, task, key, folds=5, seed=42) -> MultiLevel:
    """Each level trains on the out-of-fold predictions of the one before; a
    level of one base model ends the stack, otherwise a default meta model does.
    Lineage is cut between levels."""
    classes = _class_count(df, label, task)
    fitted, inputs, table = [], list(features), df
    for i, bases in enumerate(levels):
        named = [(f"l{i}_{n}", m, p) for n, m, p in bases]
        with cached(table) as ready:
            made = _meta_columns([b[0] for b in named], task, classes)
            rows = out_of_fold(ready, named, inputs, label, task, key, folds, seed + i).withColumns(made)
            fitted.append(_fit_bases(ready, named, inputs, label, task, key))
            table = cut_lineage(rows.select(*[q(c) for c in df.columns], *made))
        inputs = list(made)
    return MultiLevel(fitted, fit_model(table, _meta_name(task), inputs, label, task), task, classes)


# ---- comparing ------------------------------------------------------------------------


def compare_all(base_scores: DataFrame, ensemble_scores: DataFrame, metric: str) -> DataFrame:
    """(model, value) of base and ensemble models, best first; scores are
    (model, metrics map)."""

    def lines(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), "model").alias("model"), F.col("metrics")[metric].alias("value"))

    return lines(base_scores, "Base_").unionByName(lines(ensemble_scores, "Ensemble_")).orderBy(
        F.col("value").desc_nulls_last(), "model"
    )


def auto_ensemble(train, test, bases: Sequence[Base], features, label, task, key, folds=5):
    """Base models, a voting and a stacking ensemble; (best model, leaderboard)."""
    metric = "accuracy" if task == "classification" else "r2"
    with cached(train) as ready, cached(test) as held:
        models = _fit_bases(ready, bases, features, label, task, key)
        made = {"voting": Voting(models, task), "stacking": fit_stacking(ready, bases, features, label, task, key, folds)}
        base_rows = [(n, all_scores(m.transform(held), label, task)) for n, m in models.items()]
        made_rows = [(n, all_scores(m.transform(held), label, task)) for n, m in made.items()]
    spark = train.sparkSession
    schema = "model string, metrics map<string,double>"
    board = compare_all(spark.createDataFrame(base_rows, schema), spark.createDataFrame(made_rows, schema), metric)
    name = board.first()["model"]
    every = {**{f"Base_{n}": m for n, m in models.items()}, **{f"Ensemble_{n}": m for n, m in made.items()}}
    return every[name], board
