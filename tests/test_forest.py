"""Trees and forests on counted cells against MLlib's trees of rows."""

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from millrace.operators import forest, models

X = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20, 800), rng.integers(0, 12, 800)
    y = 3.0 * (a > 7) + b * (a > 12) + rng.normal(0, 0.3, 800)
    return spark.createDataFrame(
        [(int(i), float(p), float(r), float(v), int(v > 3) + int(v > 8)) for i, (p, r, v) in enumerate(zip(a, b, y))],
        "id int, a double, b double, y double, c int",
    ).cache()


def test_trees_are_those_of_rows(rows):
    ready = models.assemble(rows, X)
    for label, task, solver in (("y", "regression", R.DecisionTreeRegressor), ("c", "classification", C.DecisionTreeClassifier)):
        model = forest.fit_forest(rows, "decision_tree", X, label, task, 3 if task == "classification" else 0, {})
        theirs = solver(featuresCol="_features", labelCol=label).fit(ready)
        both = model.transform(rows).join(theirs.transform(ready).select("id", F.col("prediction").alias("p")), "id")
        assert both.where(F.abs(F.col("prediction") - F.col("p")) > 1e-9).isEmpty()
        assert np.allclose([v for _, v in model.importance()], theirs.featureImportances.toArray())


def test_forests_score_as_those_of_rows(spark, rows):
    """One set of jobs for each level, however many trees; the bags differ, the scores hardly do."""
    ready, sc = models.assemble(rows, X), spark.sparkContext
    for label, task, metric, solver in (("y", "regression", "r2", R.RandomForestRegressor), ("c", "classification", "accuracy", C.RandomForestClassifier)):
        sc.setJobGroup(f"forest-{task}", "")
        model = forest.fit_forest(rows, "random_forest", X, label, task, 3 if task == "classification" else 0, {"n_estimators": 60})
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(model.trees) == 60 and len(sc.statusTracker().getJobIdsForGroup(f"forest-{task}")) <= 30
        theirs = solver(featuresCol="_features", labelCol=label, numTrees=60, seed=1).fit(ready).transform(ready)
        assert models.score(model.transform(rows), label, metric) == pytest.approx(models.score(theirs, label, metric), abs=0.03)


def test_bags_hold_rows_and_not_units(spark):
    """A unit of n rows weighs as n single rows do in a bag."""
    n = np.full(4000, 9.0)
    w = forest._weights(n, 1, 2, (True, 0.5))
    assert w.mean() == pytest.approx(4.5, abs=0.15) and w.var() == pytest.approx(4.5, abs=0.5)
    assert (forest._weights(n, 1, 2, (True, 0.5)) == w).all()
    half = forest._weights(n, 1, 2, (False, 0.5))
    assert half.max() <= 9 and half.var() == pytest.approx(2.25, abs=0.3)
    one = spark.createDataFrame([(1.0, 5.0)], "a double, y double")
    for k in (1, 5):
        model = models.fit_model(one, "random_forest", ["a"], "y", "regression", {"n_estimators": k})
        assert isinstance(model, forest.Forest) and model.transform(one).first()["prediction"] == 5.0
