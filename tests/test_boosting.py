"""Boosting on counted cells against MLlib's boosting of rows."""

import numpy as np
import pytest
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.sql import functions as F

from millrace.operators import boosting, models

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


def test_regression_is_that_of_rows(rows):
    ours = models.fit_model(rows, "gradient_boosting", X, "y", "regression", {"n_estimators": 12}).transform(rows)
    solver = R.GBTRegressor(featuresCol="_features", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.1, seed=1)
    ready = models.assemble(rows, X)
    theirs = solver.fit(ready).transform(ready).select("id", F.col("prediction").alias("p"))
    assert ours.join(theirs, "id").where(F.abs(F.col("prediction") - F.col("p")) > 1e-6).isEmpty()


def test_two_classes_are_those_of_rows(rows):
    two = rows.withColumn("c", (F.col("c") > 0).cast("int"))
    ours = models.fit_model(two, "gradient_boosting", X, "c", "classification", {"n_estimators": 12}).transform(two)
    solver = C.GBTClassifier(featuresCol="_features", labelCol="c", maxIter=12, maxDepth=3, stepSize=0.1, seed=1)
    ready = models.assemble(two, X)
    theirs = solver.fit(ready).transform(ready)
    theirs = theirs.select("id", models.vector_to_array("probability")[1].alias("p"), F.col("prediction").alias("k"))
    both = ours.join(theirs, "id")
    assert both.where((F.abs(F.col("probability")[1] - F.col("p")) > 1e-6) | (F.col("prediction") != F.col("k"))).isEmpty()


def test_classes_share_their_passes(spark, rows):
    """One job for each level of a round, however many classes; a loop over one-vs-rest took some for each class."""
    sc = spark.sparkContext
    sc.setJobGroup("boost-three", "")
    try:
        model = models.fit_model(rows, "gradient_boosting", X, "c", "classification", {"n_estimators": 8})
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("boost-three")) <= 8 * 3 + 16
    base = C.GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.1, seed=1)
    solver = C.OneVsRest(classifier=base, featuresCol="_features", labelCol="c")
    ready = models.assemble(rows, X)
    theirs = solver.fit(ready).transform(ready).select("id", F.col("prediction").alias("k"))
    assert model.transform(rows).join(theirs, "id").where("prediction <> k").isEmpty()


def test_rows_with_gaps_and_large_values(spark):
    """Missing cells can be parted from all others; infinite ones are values; a constant column has no threshold."""
    inf = float("inf")
    rows = [(None if i % 5 == 0 else float(i % 7), inf if i % 11 == 0 else float(i), 1.0, float(i % 5 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, k double, y double")
    model = models.fit_model(df, "gradient_boosting", ["a", "b", "k"], "y", "regression", {"n_estimators": 20, "learning_rate": 0.5})
    assert models.score(model.transform(df), "y", "mae") < 0.05
    assert boosting.thresholds(df, ["k"], 32)[0].size == 0
    ends = spark.createDataFrame([(-inf, 0.0), (2.0, 1.0), (inf, 5.0)], "a double, y double")
    model = models.fit_model(ends, "gradient_boosting", ["a"], "y", "regression", {"n_estimators": 30, "learning_rate": 0.5})
    assert models.score(model.transform(ends), "y", "mae") < 0.05
