"""Residual diagnostics in row order and rank order, without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dist import BUCKET_ROWS, hash_key, q, range_buckets, value_ranks
from ..functions.normal import normal_quantile
from .distribution import histogram

COPIES_PER_STEP = 10_000


def with_residual(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", q(label).cast("double") - q(prediction).cast("double"))


def durbin_watson(
    df: DataFrame, order_by: str, label: str = "label", prediction: str = "prediction", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Squared steps between neighbours over squared residuals, in key order.

    Neighbours inside a range bucket meet in a window per bucket; the steps
    between buckets come from the first and last residual of each.
    """
    rows = with_residual(df, label, prediction).select(q(order_by).alias("k"), "residual")
    tagged = range_buckets(rows.where(F.col("residual").isNotNull()), "k", bucket_rows=bucket_rows)
    within = Window.partitionBy("_bucket").orderBy("k")
    step = F.col("residual") - F.lag("residual").over(within)
    stepped = tagged.withColumn("_step", step)
    by_bucket = stepped.groupBy("_bucket").agg(
        F.sum(F.col("_step") * F.col("_step")).alias("steps"),
        F.sum(F.col("residual") * F.col("residual")).alias("squares"),
        F.min_by("residual", "k").alias("first"),
        F.max_by("residual", "k").alias("last"),
    )
    # one row per bucket from here on
    jump = F.col("first") - F.lag("last").over(Window.orderBy("_bucket"))
    joined = by_bucket.withColumn("jump", F.coalesce(jump * jump, F.lit(0.0)))
    total = F.sum(F.coalesce("steps", F.lit(0.0)) + F.col("jump"))
    return joined.agg(F.try_divide(total, F.sum("squares")).alias("durbin_watson"))


def breusch_pagan(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """LM = n R² of squared residuals on fitted values, with p for one degree."""
    e = q(label).cast("double") - q(prediction).cast("double")
    fit = q(prediction).cast("double")
    lm = df.agg((F.regr_count(e * e, fit) * F.regr_r2(e * e, fit)).alias("lm")).first()["lm"]
    p = math.erfc(math.sqrt(lm / 2.0)) if lm is not None and not math.isnan(lm) else None
    return df.sparkSession.createDataFrame(
        [(lm, p, p is not None and p < 0.05)], "lm double, p_value double, heteroscedastic boolean"
    )


def qq_points(
    df: DataFrame, label: str = "label", prediction: str = "prediction", spread: str = "midpoint", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(position, residual, probability, theoretical) for every row.

    Distinct residuals are ranked once and repeated as often as they occur, in
    two steps so that one heavy value is spread over many tasks.
    """
    rows = with_residual(df, label, prediction).select("residual")
    n = rows.agg(F.count("residual")).first()[0]
    ranks = value_ranks(rows, "residual", bucket_rows).withColumnRenamed("value", "residual")
    chunk = F.lit(COPIES_PER_STEP)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk)))
    pieces = ranks.select("residual", "n", "before", steps.alias("piece"))
    if n > bucket_rows:
        pieces = pieces.repartition("residual", "piece")
    first = F.col("piece") * chunk
    last = F.least(first + chunk, F.col("n")) - 1
    placed = pieces.select("residual", "before", F.explode(F.sequence(first, last)).alias("i"))
    position = F.col("before") + F.col("i")
    if spread == "midpoint":
        prob = (position + 0.5) / F.lit(float(n))
    else:
        prob = 0.01 + position * F.lit(0.98 / max(n - 1, 1))
    return placed.select(position.alias("position"), "residual", prob.alias("probability")).withColumn(
        "theoretical", normal_quantile(F.col("probability"))
    )


def scale_location(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Add sqrt(|e / std(e)|), with the population deviation."""
    rows = with_residual(df, label, prediction)
    std = rows.agg(F.stddev_pop("residual")).first()[0]
    spread = F.sqrt(F.abs(F.col("residual") / F.lit(std if std else None).cast("double")))
    return rows.withColumn("sqrt_abs_standardized", spread)


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    return histogram(with_residual(df, label, prediction).select("residual"), ["residual"], bins).drop("column_name")


def prediction_sample(
    df: DataFrame, key: str, size: int = 1000, seed: int = 42, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """A seeded sample of at most `size` rows for a scatter plot, with the
    absolute error of each and the R² of all rows."""
    from .metrics import regression_metrics

    r2 = regression_metrics(df, label, prediction).first()["r2"]
    error = F.abs(q(label).cast("double") - q(prediction).cast("double"))
    return (
        df.select(q(key), q(label), q(prediction), error.alias("abs_error"), F.lit(r2).cast("double").alias("r2"))
        .orderBy(hash_key(key, seed))
        .limit(size)
    )
