"""Hyperparameter search: sampled trials, pruning and several objectives.

The driver holds one small record per trial; every trial's work is MLlib fits
over a cached table, a few trials at a time.
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import LOWER_IS_BETTER, Metric, cached, cross_validate, fit_model, metric_name, score
from .split import nested_samples, train_test_split
from .trials import pareto_front, prune_below_median

TRIALS = "trial int, value double, state string, started timestamp, duration_s double, params map<string,string>"


@dataclass(frozen=True)
class Param:
    """One dimension: int or float range (optional step or log), or choices.
    `when` = (other parameter, value) makes it conditional."""

    kind: str
    low: float = 0.0
    high: float = 1.0
    step: float | None = None
    log: bool = False
    choices: tuple = ()
    when: tuple | None = None

    def at(self, u: float) -> Any:
        """Value at position u in [0, 1)."""
        if self.kind == "categorical":
            return self.choices[min(int(u * len(self.choices)), len(self.choices) - 1)]
        step = self.step or (1 if self.kind == "int" and not self.log else None)
        if step:
            slots = math.floor((self.high - self.low) / step + 1e-9) + 1
            v = self.low + step * min(int(u * slots), slots - 1)
        elif self.log:
            v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            v = self.low + u * (self.high - self.low)
        return int(round(v)) if self.kind == "int" else float(v)

    def grid(self, levels: int) -> list:
        if self.kind == "categorical":
            return list(self.choices)
        seen = []
        for i in range(levels):
            v = self.at(min(i / max(levels - 1, 1), 1 - 1e-12))
            if v not in seen:
                seen.append(v)
        return seen


Space = dict[str, Param]


def _resolve(space: Space, raw: dict[str, Any]) -> dict[str, Any]:
    """Drop conditional parameters whose condition does not hold."""
    out: dict[str, Any] = {}
    for name, p in space.items():
        if p.when is None or out.get(p.when[0]) == p.when[1]:
            out[name] = raw[name]
    return out


def sample_points(space: Space, n: int, method: str = "random", seed: int = 42, skip: int = 0, levels: int = 5) -> list[dict]:
    """Seeded parameter points; `skip` continues a sequence already used."""
    names = list(space)
    if method == "grid":
        seen: list[dict] = []
        for combo in itertools.product(*[space[k].grid(levels) for k in names]):
            point = _resolve(space, dict(zip(names, combo)))
            if point not in seen:
                seen.append(point)
        return seen[skip : skip + n]
    rng = np.random.default_rng(seed)
    if method == "lhs":
        # one stratum of n per dimension and point, in a shuffled order
        rng = np.random.default_rng([seed, skip])
        u = np.column_stack([(rng.permutation(n) + rng.uniform(size=n)) / n for _ in names]) if names else np.empty((n, 0))
    elif method == "random":
        u = rng.uniform(size=(skip + n, len(names)))[skip:]
    else:
        raise ValueError(f"unknown sampling method {method}")
    return [_resolve(space, {k: space[k].at(float(x)) for k, x in zip(names, row)}) for row in u]


def direction_of(metric: Metric) -> str:
    """A user's metric is larger for better models (`metrics.scorer` turns the sign of others)."""
    return "minimize" if metric in LOWER_IS_BETTER else "maximize"


@dataclass
class Study:
    space: Space
    direction: str = "maximize"
    method: str = "random"
    seed: int = 42
    rows: list[tuple] = field(default_factory=list)
    points: dict[int, dict] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, TRIALS)

    @property
    def best(self) -> tuple[int, float, dict] | None:
        """(trial, value, params) of the best complete trial."""
        done = [r for r in self.rows if r[2] == "COMPLETE"]
        if not done:
            return None
        sign = -1 if self.direction == "maximize" else 1
        r = min(done, key=lambda x: (sign * x[1], x[0]))
        return r[0], r[1], self.points[r[0]]

    def run(
        self, objective: Callable[[dict], float], n_trials: int, timeout: float | None = None, parallelism: int = 2,
        on_trial: Callable[[tuple], None] | None = None,
    ) -> Study:
        """Add up to `n_trials` trials; none starts after the deadline.  A trial
        whose objective raises is recorded as failed.  Calling again continues."""
        deadline = time.monotonic() + timeout if timeout is not None else math.inf
        start = len(self.points)
        points = sample_points(self.space, n_trials, self.method, self.seed, skip=start)

        def one(item):
            trial, params = item
            if time.monotonic() > deadline:
                return None
            began, clock = datetime.now(timezone.utc).replace(tzinfo=None), time.monotonic()
            try:
                value, state = float(objective(params)), "COMPLETE"
                if math.isnan(value):
                    value, state = None, "FAIL"
            except Exception:  # a failed trial is a result, not the end
                value, state = None, "FAIL"
            text = {k: str(v) for k, v in params.items()}
            row = (trial, value, state, began, time.monotonic() - clock, text)
            if on_trial:
                on_trial(row)
            return row

        items = [(start + i, p) for i, p in enumerate(points)]
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            for (trial, params), row in zip(items, pool.map(one, items)):
                if row is not None:
                    self.points[trial] = params
                    self.rows.append(row)
        return self


def model_objective(
    df: DataFrame, name: str, features: Sequence[str], label: str, task: str, key: str, metric: Metric,
    folds: int | None = 5, valid: DataFrame | None = None, seed: int = 42,
) -> Callable[[dict], float]:
    """Mean fold score, or the score on `valid` when given; natural sign."""

    def objective(params: dict) -> float:
        if valid is not None:
            model = fit_model(df, name, features, label, task, params, key)
            return score(model.transform(valid), label, metric)
        rows = cross_validate(df, name, features, label, task, key, folds or 5, [metric], params, seed, parallelism=1)
        return rows.agg(F.avg("value")).first()[0]

    return objective


def tune_model(
    df: DataFrame, name: str, features: Sequence[str], label: str, task: str, key: str, space: Space,
    n_trials: int = 20, timeout: float | None = None, metric: Metric | None = None, folds: int = 5,
    valid: DataFrame | None = None, method: str = "random", seed: int = 42, parallelism: int = 2,
    study: Study | None = None,
):
    """Search and refit the best on all rows: (study, model).  Pass a study to
    continue it."""
    metric = metric or ("accuracy" if task == "classification" else "r2")
    study = study or Study(space, direction_of(metric), method, seed)
    with cached(df) as ready:
        objective = model_objective(ready, name, features, label, task, key, metric, folds, valid, seed)
        study.run(objective, n_trials, timeout, parallelism)
        best = study.best
        model = fit_model(ready, name, features, label, task, best[2], key) if best else None
    return study, model


def successive_halving(
    df: DataFrame, name: str, features: Sequence[str], label: str, task: str, key: str, space: Space,
    n_trials: int = 8, shares: Sequence[float] = (0.25, 0.5, 1.0), metric: Metric | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Score all points on a small sample, keep those not below the median, and
    repeat on larger samples that contain the earlier ones.

    Returns (trials, scores per round)."""
    metric = metric or ("accuracy" if task == "classification" else "r2")
    direction = direction_of(metric)
    spark = df.sparkSession
    points = dict(enumerate(sample_points(space, n_trials, "random", seed)))
    alive = dict(points)
    scores: list[tuple] = []
    last: dict[int, float] = {}
    train_set, valid_set = train_test_split(df, key, 0.2, seed, label if task == "classification" else None)
    with cached(train_set) as train, cached(valid_set) as valid:
        for r, sample in enumerate(nested_samples(train, key, list(shares), seed)):
            for t, params in alive.items():
                last[t] = score(fit_model(sample, name, features, label, task, params, key).transform(valid), label, metric)
                scores.append((r, t, last[t]))
            if r < len(shares) - 1:
                now = spark.createDataFrame([s for s in scores if s[0] == r], "round int, trial int, value double")
                kept = {x["trial"] for x in prune_below_median(now, direction).where("keep").collect()}
                alive = {t: p for t, p in alive.items() if t in kept}
    rows = [
        (t, last[t], "COMPLETE" if t in alive else "PRUNED", None, None, {k: str(v) for k, v in p.items()})
        for t, p in points.items()
    ]
    return spark.createDataFrame(rows, TRIALS), spark.createDataFrame(scores, "round int, trial int, value double")


def tune_many_objectives(
    df: DataFrame, name: str, features: Sequence[str], label: str, task: str, key: str, space: Space,
    metrics: Sequence[Metric], n_trials: int = 10, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Several metrics per trial on one hold-out: (trials, Pareto front)."""
    train_set, valid_set = train_test_split(df, key, 0.2, seed, label if task == "classification" else None)
    rows = []
    with cached(train_set) as train, cached(valid_set) as valid:
        for t, params in enumerate(sample_points(space, n_trials, "random", seed)):
            try:
                predictions = fit_model(train, name, features, label, task, params, key).transform(valid)
                values, state = [score(predictions, label, m) for m in metrics], "COMPLETE"
            except Exception:  # a failed trial is a result, not the end
                values, state = [None] * len(metrics), "FAIL"
            rows.append((t, state, {k: str(v) for k, v in params.items()}, *values))
    schema = "trial int, state string, params map<string,string>, " + ", ".join(f"{metric_name(m)} double" for m in metrics)
    trials = df.sparkSession.createDataFrame(rows, schema)
    return trials, pareto_front(trials, {metric_name(m): direction_of(m) for m in metrics})
