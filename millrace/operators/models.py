"""Model families on MLlib with one interface, plus kNN and AdaBoost.R2 jobs.

A table goes in with numeric feature columns and a label column (classes as
0 … k-1); predictions come back as added columns `prediction` and, for
classifiers, `probability` (array of doubles).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import q
from ..session import cached, cut_lineage
from . import boosting, forest
from .metrics import (
    accuracy,
    averaged_scores,
    confusion_counts,
    log_loss,
    regression_aggregates,
    regression_metrics,
)
from .logistic import MOST_PARAMETERS, Softmax, fit_softmax, parameters
from .neighbors import knn_predict

SEED = 42
TASK_ROWS = 50_000
#: rows that a pass lifts at once
PASS_ROWS = 4096


# ---- fitted models -------------------------------------------------------------


@dataclass
class FittedModel:
    name: str
    task: str
    features: list[str]
    model: Transformer | Softmax
    classes: int = 0
    lift: Callable[[DataFrame], DataFrame] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        work = self.lift(df) if self.lift else assemble(df, self.features)
        out = self.model.transform(work)
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        cols = [F.col("prediction").cast("double").alias("prediction")]
        if self.task == "classification":
            cols.append(self._probability(out).alias("probability"))
        return out.select(*kept, *cols)

    def _probability(self, out: DataFrame) -> Column:
        if "probability" in out.columns:
            vector = out.schema["probability"].dataType.typeName() != "array"
            return vector_to_array("probability") if vector else F.col("probability")
        # margins only: logistic of each margin, normalised over the classes
        raw = vector_to_array("rawPrediction")
        p = F.transform(raw, lambda m: 1.0 / (1.0 + F.exp(-m)))
        total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
        return F.transform(p, lambda x: x / total)

    def importance(self) -> list[tuple[str, float]]:
        m = self.model
        if hasattr(m, "featureImportances"):
            values = m.featureImportances.toArray()
        elif hasattr(m, "coefficientMatrix"):
            values = np.abs(m.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(m, "coefficients"):
            values = m.coefficients.toArray()
        elif hasattr(m, "models"):
            parts = [FittedModel(self.name, self.task, self.features, sub).importance() for sub in m.models]
            values = np.mean([[v for _, v in p] for p in parts], axis=0)
        else:
            return []
        return list(zip(self.features, [float(v) for v in values]))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep").transform(df)


#: models whose result does not depend on the partitions
LINEAR = {"linear_regression", "ridge", "lasso", "elastic_net", "huber", "logistic_regression", "linear_svm", "linear_svr", "svm"}


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """Iterative solvers run a job per step, so a small set is read by few
    tasks; above TASK_ROWS per core nothing changes."""
    tasks = math.ceil(rows / TASK_ROWS)
    return df.coalesce(tasks) if tasks < df.sparkSession.sparkContext.defaultParallelism else df


@dataclass
class NeighborModel:
    """k nearest neighbours; keeps the training frame and joins at prediction."""

    name: str
    task: str
    features: list[str]
    train: DataFrame
    label: str
    key: str
    classes: int
    params: dict[str, Any] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        found = knn_predict(
            df,
            self.train,
            self.features,
            self.label,
            self.key,
            self.key,
            k=int(self.params.get("n_neighbors", 5)),
            task=self.task,
            weights=self.params.get("weights", "uniform"),
            p=int(self.params.get("p", 2)),
        )
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        out = df.select(*kept).join(found.withColumnRenamed("query_id", self.key), self.key, "left")
        if self.task == "classification":
            share = F.transform(
                F.sequence(F.lit(0), F.lit(self.classes - 1)), lambda i: F.coalesce(F.element_at("shares", i), F.lit(0.0))
            )
            out = out.withColumn("probability", share)
        return out.select(*kept, "prediction", *(["probability"] if self.task == "classification" else []))

    def importance(self):
        return []


@dataclass
class BoostedTrees:
    """AdaBoost.R2: trees with weights; predicts their weighted median."""

    name: str
    task: str
    features: list[str]
    trees: list
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = assemble(df, self.features)
        for i, t in enumerate(self.trees):
            out = t.copy({t.predictionCol: f"_p{i}"}).transform(out)
        half = sum(self.weights) / 2.0
        pairs = F.array_sort(
            F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(self.weights)])
        )
        # first prediction at which the running weight reaches half
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        median = F.aggregate(
            pairs,
            start,
            lambda a, x: F.struct(
                (a["sum"] + x["w"]).alias("sum"),
                F.when(a["at"].isNull() & (a["sum"] + x["w"] >= half), x["p"]).otherwise(a["at"]).alias("at"),
            ),
        )
        kept = [q(c) for c in df.columns if c != "prediction"]
        return out.select(*kept, median["at"].alias("prediction"))

    def importance(self):
        total = np.sum([w * t.featureImportances.toArray() for w, t in zip(self.weights, self.trees)], axis=0)
        return list(zip(self.features, [float(v) for v in total / max(sum(self.weights), 1e-300)]))


# ---- estimators ------------------------------------------------------------------

IO = {"featuresCol": "_features", "predictionCol": "prediction"}


_TREE = {"max_depth", "min_samples_leaf", "max_bins", "min_impurity_decrease", "criterion"}
_FOREST = _TREE | {"n_estimators", "max_features", "bootstrap", "max_samples"}
_BOOST = (_TREE - {"criterion"}) | {"n_estimators", "learning_rate", "subsample", "max_features"}
#: parameters that change the estimator of each model; any other name is an error
PARAMS = {
    "random_forest": _FOREST,
    "gradient_boosting": _BOOST,
    "decision_tree": _TREE,
    "logistic_regression": {"max_iter", "C", "tol", "penalty", "l1_ratio"},
    "naive_bayes": set(),
    "linear_svm": {"max_iter", "C", "tol"},
    "linear_svr": {"max_iter", "C", "tol", "epsilon"},
    "svm": {"max_iter", "C", "tol", "components", "gamma", "epsilon"},
    "linear_regression": set(),
    "ridge": {"alpha"},
    "lasso": {"alpha", "max_iter"},
    "elastic_net": {"alpha", "l1_ratio", "max_iter"},
    "huber": {"alpha", "epsilon", "max_iter"},
    "knn": {"n_neighbors", "weights", "p"},
    "adaboost": {"n_estimators", "learning_rate", "max_depth"},
}


def check_params(name: str, params: dict) -> None:
    unknown = sorted(set(params) - PARAMS.get(name, set(params)))
    if unknown:
        raise ValueError(f"{name} has no parameters {unknown}; known are {sorted(PARAMS[name])}")


def _tree_args(p: dict) -> dict:
    names = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_bins": "maxBins"}
    out: dict = {names[k]: int(v) for k, v in p.items() if k in names and v is not None}
    if p.get("min_impurity_decrease") is not None:
        out["minInfoGain"] = float(p["min_impurity_decrease"])
    if p.get("criterion") is not None:
        out["impurity"] = {"squared_error": "variance"}.get(p["criterion"], p["criterion"])
    if "max_features" in p:
        given = {None: "all", "log2": "log2", "sqrt": "sqrt"}
        out["featureSubsetStrategy"] = given.get(p["max_features"], str(p["max_features"]))
    return out


def _forest_args(p: dict) -> dict:
    out = _tree_args(p)
    if p.get("bootstrap") is not None:
        out["bootstrap"] = bool(p["bootstrap"])
    if p.get("max_samples") is not None:
        out["subsamplingRate"] = float(p["max_samples"])
    return out


def classifier(name: str, label: str, n: int, classes: int, p: dict):
    """An MLlib estimator; `n` is the number of training rows, for penalties
    that are defined on sums."""
    io = {**IO, "labelCol": label}
    if name == "random_forest":
        return C.RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), seed=SEED, **_forest_args(p), **io)
    if name == "gradient_boosting":
        args = {"maxIter": int(p.get("n_estimators", 100)), "stepSize": float(p.get("learning_rate", 0.1))}
        args["subsamplingRate"] = float(p.get("subsample", 1.0))
        args["maxDepth"] = 3
        args.update(_tree_args(p))
        base = C.GBTClassifier(seed=SEED, **args, **io)
        return base if classes <= 2 else C.OneVsRest(classifier=base, parallelism=2, **io)
    if name == "logistic_regression":
        ratio = {"l1": 1.0, "elasticnet": float(p.get("l1_ratio", 0.5))}.get(p.get("penalty"), 0.0)
        return C.LogisticRegression(
            elasticNetParam=ratio, maxIter=int(p.get("max_iter", 1000)), regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), standardization=False, tol=float(p.get("tol", 1e-6)), **io
        )
    if name == "decision_tree":
        return C.DecisionTreeClassifier(seed=SEED, **_tree_args(p), **io)
    if name == "naive_bayes":
        return C.NaiveBayes(modelType="gaussian", **io)
    if name in ("linear_svm", "svm"):
        base = C.LinearSVC(maxIter=int(p.get("max_iter", 100)), tol=float(p.get("tol", 1e-4)), regParam=1.0 / (float(p.get("C", 1.0)) * max(n, 1)), **io)
        return base if classes <= 2 else C.OneVsRest(classifier=base, parallelism=2, **io)
    raise ValueError(f"unknown classifier {name}")


def regressor(name: str, label: str, n: int, spread: float, p: dict):
    """As `classifier`.  MLlib solves on the label divided by its deviation
    `spread`, which leaves L1 penalties alone but divides L2 penalties by it;
    the factors here undo that."""
    io = {**IO, "labelCol": label}
    alpha = float(p.get("alpha", 1.0))
    if name == "linear_regression":
        return R.LinearRegression(solver="normal", **io)
    if name == "ridge":
        return R.LinearRegression(regParam=alpha * spread / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal", **io)
    if name in ("lasso", "elastic_net"):
        ratio = 1.0 if name == "lasso" else float(p.get("l1_ratio", 0.5))
        l1, l2 = alpha * ratio, alpha * (1.0 - ratio) * spread
        return R.LinearRegression(
            regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, standardization=False, maxIter=int(p.get("max_iter", 2000)), tol=1e-10, **io
        )
    if name == "huber":
        return R.LinearRegression(
            loss="huber", epsilon=float(p.get("epsilon", 1.35)), maxIter=int(p.get("max_iter", 1000)), regParam=float(p.get("alpha", 0.0001)) / max(n, 1), standardization=False, **io
        )
    if name == "random_forest":
        return R.RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), seed=SEED, **_forest_args(p), **io)
    if name == "gradient_boosting":
        args = {"maxIter": int(p.get("n_estimators", 100)), "stepSize": float(p.get("learning_rate", 0.1))}
        args["subsamplingRate"] = float(p.get("subsample", 1.0))
        args["maxDepth"] = 3
        args.update(_tree_args(p))
        return R.GBTRegressor(seed=SEED, **args, **io)
    if name == "decision_tree":
        return R.DecisionTreeRegressor(seed=SEED, **_tree_args(p), **io)
    raise ValueError(f"unknown regressor {name}")


CLASSIFIERS = ("random_forest", "gradient_boosting", "logistic_regression", "svm", "decision_tree", "knn", "naive_bayes")
REGRESSORS = (
    "linear_regression", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting",
    "svm", "decision_tree", "knn", "adaboost", "huber",
)
DEFAULT_REGRESSORS = ("linear_regression", "ridge", "random_forest", "gradient_boosting")


@dataclass
class FourierLift:
    """Random Fourier features of standardised columns, as column `_features`."""

    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    b: np.ndarray

    def raw(self) -> Column:
        """The features as an array, means for missing ones."""
        return F.array(*[F.coalesce(q(c).cast("double"), F.lit(float(m))) for c, m in zip(self.features, self.mean)])

    def __call__(self, table: DataFrame) -> DataFrame:
        project = self.projection()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def lifted(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(project(np.vstack(x.to_numpy()))))

        return table.withColumn("_features", array_to_vector(lifted(self.raw())))

    def projection(self) -> Callable[[np.ndarray], np.ndarray]:
        """From rows of `raw` to their lifted features."""
        mean, std, w, b = self.mean, self.std, self.w, self.b
        scale = math.sqrt(2.0 / len(b))
        return lambda x: scale * np.cos((x - mean) / std @ w + b)


def fourier_features(df: DataFrame, features: Sequence[str], size: int, gamma: float | None, seed: int = SEED):
    """Fit random Fourier features of an RBF kernel (Rahimi and Recht 2007) on
    standardised columns.  Returns the lift used for training and prediction."""
    row = df.agg(
        *[e for i, c in enumerate(features) for e in (F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c).cast("double")).alias(f"s{i}"))]
    ).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(features))])
    std = np.array([row[f"s{i}"] or 1.0 for i in range(len(features))])
    gamma = gamma if gamma is not None else 1.0 / len(features)
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2.0 * gamma), size=(len(features), size))
    b = rng.uniform(0.0, 2.0 * math.pi, size=size)

    return FourierLift(list(features), mean, std, w, b)


@dataclass
class LinearTubes:
    """Support vector regression: a line on (lifted) features."""

    name: str
    task: str
    features: list[str]
    weights: np.ndarray
    intercept: float
    lift: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c != "prediction"]
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        dot = F.aggregate(F.zip_with(vector_to_array("_features"), w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return self.lift(df).select(*kept, (dot + F.lit(self.intercept)).alias("prediction"))

    def importance(self):
        return list(zip(self.features, [float(v) for v in self.weights])) if len(self.weights) == len(self.features) else []


def fit_svr(df: DataFrame, features: Sequence[str], label: str, params: dict, name: str, spread: float) -> LinearTubes:
    """Epsilon-insensitive regression by iteratively reweighted least squares.

    Minimises |w|^2 / 2 + C sum max(0, |y - wx - b| - epsilon).  Residuals
    outside the tube get weight C / (distance to the tube) and the tube's edge
    as target, those inside none; one aggregation of a (size + 1)^2 matrix a
    step, halved steps while the loss grows.  The table is kept with its raw
    features; a pass lifts them and returns one matrix from each task.
    """
    if name == "svm":
        lift = fourier_features(df, features, int(params.get("components", 100)), params.get("gamma"))
    else:
        def lift(table):
            return assemble(table, features)
    c, tube = float(params.get("C", 1.0)), float(params.get("epsilon", 0.1))
    if name == "svm":
        raw, project = lift.raw(), lift.projection()
    else:
        raw = F.array(*[F.coalesce(q(f).cast("double"), F.lit(float("nan"))) for f in features])
        project = np.asarray
    rows = df.select(raw.alias("x"), q(label).cast("double").alias("y"))
    floor = 1e-3 * spread

    def step(at: np.ndarray | None):
        def run(batches):
            total = 0.0
            for whole in batches:
                for first in range(0, whole.num_rows, PASS_ROWS):
                    batch = whole.slice(first, PASS_ROWS)
                    x = project(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
                    x = np.hstack([x, np.ones((len(x), 1))])
                    y = batch.column("y").to_numpy()
                    if at is None:
                        weight, target, loss = np.full(len(y), c / spread), y, 0.0
                    else:
                        r = y - x @ at
                        over = np.abs(r) - tube
                        weight = np.where(over > 0, c / np.maximum(over, floor), 0.0)
                        target, loss = y - np.sign(r) * tube, c * np.maximum(over, 0).sum()
                    weighted = (x * weight[:, None]).T
                    total = total + np.append((weighted @ x).ravel(), [*(weighted @ target), loss])
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        parts = ready.mapInArrow(run, "i int, v double")
        sums = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()  # (size + 1)^2 numbers
        flat = np.zeros(len(sums))
        for r in sums:
            flat[r["i"]] = r["v"]
        k = int(round((-1 + math.sqrt(1 + 4 * (len(flat) - 1))) / 2))
        return flat[: k * k].reshape(k, k), flat[k * k : -1], flat[-1]

    with cached(rows) as ready:
        left, right, _ = step(None)
        k = len(right)
        ridge = np.eye(k)
        ridge[-1, -1] = 1e-9
        now = np.linalg.solve(left + ridge, right)
        best, lowest = now, math.inf
        for _ in range(int(params.get("max_iter", 100))):
            left, right, loss = step(now)
            loss += now[:-1] @ now[:-1] / 2
            if loss < lowest * (1 - float(params.get("tol", 1e-4))):
                best, lowest = now, loss
                now = np.linalg.solve(left + ridge, right)
            elif np.abs(now - best).max() > 1e-6 * max(1.0, np.abs(best).max()):
                now = (now + best) / 2
            else:
                break
    return LinearTubes(name, "regression", list(features), best[:-1], float(best[-1]), lift)


def fit_adaboost(df: DataFrame, features: Sequence[str], label: str, params: dict) -> BoostedTrees:
    """Drucker's AdaBoost.R2 with linear loss and weighted trees.

    Each round is one tree fit, one pass for the largest error and one for the
    weighted loss; weights are a column and lineage is cut every round.
    """
    rounds, rate = int(params.get("n_estimators", 100)), float(params.get("learning_rate", 1.0))
    work = assemble(df, features).select("_features", q(label).cast("double").alias("_y"), F.lit(1.0).alias("_w"))
    work = cut_lineage(work)
    trees, weights = [], []
    for i in range(rounds):
        total = work.agg(F.sum("_w")).first()[0]
        work = work.withColumn("_w", F.col("_w") / F.lit(total))
        tree = R.DecisionTreeRegressor(
            featuresCol="_features", labelCol="_y", weightCol="_w", predictionCol="_p", maxDepth=int(params.get("max_depth", 3)), seed=SEED + i, minWeightFractionPerNode=0.0
        ).fit(work)
        scored = tree.transform(work).withColumn("_e", F.abs(F.col("_p") - F.col("_y")))
        top = scored.agg(F.max("_e")).first()[0] or 0.0
        if top == 0.0:
            trees.append(tree)
            weights.append(1.0)
            break
        loss = scored.agg(F.sum(F.col("_w") * F.col("_e") / F.lit(top))).first()[0]
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = loss / (1.0 - loss)
        trees.append(tree)
        weights.append(rate * math.log(1.0 / beta))
        if i < rounds - 1:
            factor = F.pow(F.lit(beta), (1.0 - F.col("_e") / F.lit(top)) * F.lit(rate))
            work = cut_lineage(scored.select("_features", "_y", (F.col("_w") * factor).alias("_w")))
    return BoostedTrees("adaboost", "regression", list(features), trees, weights)


def fit_model(
    df: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    task: str,
    params: dict | None = None,
    key: str | None = None,
):
    """Fit one model; rows without a label are left out."""
    params = params or {}
    features = list(features)
    train = df.where(q(label).isNotNull())
    facts = train.agg(F.count(F.lit(1)).alias("n"), F.max(q(label)).alias("top"), F.stddev_pop(q(label).cast("double")).alias("spread")).first()
    n = facts["n"]
    if n == 0:
        raise ValueError("no training rows")
    classes = int(facts["top"]) + 1 if task == "classification" else 0
    if name == "knn":
        check_params(name, params)
        if key is None:
            raise ValueError("knn needs a row key")
        return NeighborModel(name, task, features, train, label, key, classes, params)
    check_params(name, params)
    if name in ("svm", "linear_svr") and task == "regression":
        return fit_svr(train, features, label, params, name, facts["spread"] or 1.0)
    if name == "adaboost" and task == "regression":
        return fit_adaboost(train, features, label, params)
    if name == "gradient_boosting" and boosting.handles(params):
        return boosting.fit_boosting(train, features, label, task, classes, params)
    if name == "random_forest" and task == "regression" and forest.handles(params, task, len(features)):
        return forest.fit_forest(train, name, features, label, task, classes, params)
    if task == "classification":
        estimator = classifier(name, label, n, classes, params)
    else:
        estimator = regressor(name, label, n, facts["spread"] or 1.0, params)
    lift = None
    if name == "svm":
        lift = fourier_features(train, features, int(params.get("components", 100)), params.get("gamma"))
    ready = lift(train) if lift else assemble(train, features)
    ready = ready.select("_features", q(label).cast("double").alias(label))
    if name in LINEAR:  # trees draw their bags per partition, so only solvers may be given fewer
        ready = few_tasks(ready, n)
    smooth = name == "logistic_regression" and params.get("penalty") in (None, "l2")
    if smooth and parameters(classes, len(features)) <= MOST_PARAMETERS:
        with cached(ready) as kept:
            model = fit_softmax(kept, label, classes, n, estimator.getRegParam())
    else:
        model = estimator.fit(ready)
    return FittedModel(name, task, features, model, classes, lift)


# ---- scoring and training many ------------------------------------------------------

LOWER_IS_BETTER = {"mse", "rmse", "mae", "mape", "max_error", "log_loss"}


#: a name, or a function from the prediction frame to a number (see `metrics.scorer`)
Metric = str | Callable[[DataFrame], float]


def metric_name(metric: Metric) -> str:
    return metric if isinstance(metric, str) else getattr(metric, "__name__", type(metric).__name__)


def score(predictions: DataFrame, label: str, metric: Metric) -> float:
    """One metric of a prediction frame, in its natural sign; a user's metric as the function returns it."""
    known = regression_aggregates(label, "prediction")
    if callable(metric):
        value = metric(predictions)
    elif metric in known:
        value = predictions.agg(known[metric].alias("v")).first()["v"]
    elif metric == "accuracy":
        value = predictions.agg(F.avg((q(label) == F.col("prediction")).cast("double"))).first()[0]
    elif metric == "log_loss":
        value = log_loss(predictions, label).first()[0]
    elif metric == "roc_auc":
        from .curves import auc

        value = auc(predictions, label).first()[0]
    elif metric in ("precision", "recall", "f1"):
        counts = confusion_counts(predictions, label)
        value = averaged_scores(counts).where("average = 'weighted'").first()[metric]
    else:
        raise ValueError(f"unknown metric {metric}")
    return math.nan if value is None else float(value)


def all_scores(predictions: DataFrame, label: str, task: str) -> dict[str, float]:
    if task == "regression":
        row = regression_metrics(predictions, label).first().asDict()
    else:
        from .curves import auc

        # several small jobs read the predictions; keep just the scored columns
        with cached(predictions.select(q(label), "prediction", "probability")) as scored:
            with cached(confusion_counts(scored, label)) as counts:
                row = averaged_scores(counts).where("average = 'weighted'").first().asDict()
                row["accuracy"] = accuracy(counts).first()[0]
            row["roc_auc"] = auc(scored, label).first()[0]
        row.pop("average")
    return {k: float(v) for k, v in row.items() if v is not None}


def train(
    train_set: DataFrame, test_set: DataFrame, name: str, features: Sequence[str], label: str, task: str,
    params: dict | None = None, key: str | None = None, metrics: Sequence[Metric] = (),
):
    """Fit, predict the test set and score it: (model, predictions, metrics); `metrics` are scored besides the usual ones."""
    model = fit_model(train_set, name, features, label, task, params, key)
    predictions = model.transform(test_set)
    more = {metric_name(m): score(predictions, label, m) for m in metrics}
    return model, predictions, {**all_scores(predictions, label, task), **more}


def train_many(
    train_set: DataFrame,
    test_set: DataFrame,
    features: Sequence[str],
    label: str,
    task: str,
    names: Sequence[str] | None = None,
    params: dict[str, dict] | None = None,
    key: str | None = None,
    parallelism: int = 2,
) -> tuple[dict, DataFrame]:
    """Fit several models over one cached train set; a failure becomes a row.

    Returns the fitted models and the leaderboard
    (model, metrics map, error)."""
    names = list(names or (CLASSIFIERS if task == "classification" else DEFAULT_REGRESSORS))
    fitted: dict = {}

    def one(name: str):
        try:
            model, _, metrics = train(train_ready, test_ready, name, features, label, task, (params or {}).get(name), key)
            fitted[name] = model
            return name, metrics, None
        except Exception as e:  # isolate one model's failure
            return name, None, str(e).splitlines()[0][:500]

    with cached(train_set) as train_ready, cached(test_set) as test_ready:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(one, names))
    board = train_set.sparkSession.createDataFrame(rows, "model string, metrics map<string,double>, error string")
    return fitted, board


def best_model(board: DataFrame, metric: str, minimize: bool = False) -> DataFrame:
    """Best leaderboard row; a missing metric is 0 when maximising, the worst otherwise."""
    value = F.col("metrics")[metric]
    order = value.asc_nulls_last() if minimize else F.coalesce(value, F.lit(0.0)).desc()
    return board.where("error IS NULL").select("model", value.alias("value")).orderBy(order, "model").limit(1)


def importance_table(spark, model) -> DataFrame:
    """(feature, importance), largest magnitude first; one row per feature."""
    rows = model.importance()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.abs("importance").desc(), "feature")


def cross_validate(
    df: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    task: str,
    key: str,
    folds: int = 5,
    metrics: Sequence[Metric] | None = None,
    params: dict | None = None,
    seed: int = SEED,
    parallelism: int = 2,
) -> DataFrame:
    """(fold, metric, value): each fold scored by a model of the others; metrics are names or a user's functions."""
    from .split import mark_folds

    metrics = list(metrics or (["accuracy"] if task == "classification" else ["r2"]))
    stratify = label if task == "classification" else None

    def one(fold: int):
        model = fit_model(ready.where(F.col("fold") != fold), name, features, label, task, params, key)
        predictions = model.transform(ready.where(F.col("fold") == fold))
        return [(fold, metric_name(m), score(predictions, label, m)) for m in metrics]

    with cached(mark_folds(df, key, folds, seed, stratify)) as ready:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = [r for part in pool.map(one, range(folds)) for r in part]
    return df.sparkSession.createDataFrame(rows, "fold int, metric string, value double")


def learning_curve(
    train_set: DataFrame, valid_set: DataFrame, name: str, features: Sequence[str], label: str, task: str, key: str,
    shares: Sequence[float] = (0.1, 0.25, 0.5, 1.0), metric: str | None = None, params: dict | None = None,
) -> DataFrame:
    """(size, fold, train_score, valid_score) on growing samples of the train set."""
    from .split import nested_samples

    metric = metric or ("accuracy" if task == "classification" else "r2")
    rows = []
    with cached(train_set) as ready, cached(valid_set) as valid:
        for share, sample in zip(shares, nested_samples(ready, key, list(shares))):
            model = fit_model(sample, name, features, label, task, params, key)
            rows.append(
                (float(share), 0, score(model.transform(sample), label, metric), score(model.transform(valid), label, metric))
            )
    return train_set.sparkSession.createDataFrame(rows, "size double, fold int, train_score double, valid_score double")
