"""Histograms and density curves: the numbers behind a distribution plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import exact_quantiles, numeric_columns, q


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[f(q(c)).cast("double").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))]
    ).first()
    out = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is not None:
            out[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    return out


def equal_width_bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based bin of a value; the last bin is closed on the right."""
    width = (hi - lo) / bins
    place = F.least(F.floor((c.cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    return F.when(c.isNotNull(), place).cast("long")


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """(column_name, bin, lower, upper, n) with empty bins as 0."""
    columns = list(columns if columns is not None else numeric_columns(df))
    ranges = _ranges(df, columns)
    spark = df.sparkSession
    frame = spark.createDataFrame(
        [
            (c, b, lo + (hi - lo) / bins * b, lo + (hi - lo) / bins * (b + 1))
            for c, (lo, hi) in ranges.items()
            for b in range(bins)
        ],
        "column_name string, bin long, lower double, upper double",
    )
    if not ranges:
        return frame.withColumn("n", F.lit(0).cast("long"))
    cells = [
        F.struct(F.lit(c).alias("column_name"), equal_width_bin(q(c), *ranges[c], bins).alias("bin"))
        for c in ranges
    ]
    counts = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("column_name", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # `frame` has columns x bins rows.
    return (
        F.broadcast(frame)
        .join(counts, ["column_name", "bin"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    )


def density(df: DataFrame, column: str, points: int = 100, bins: int = 30) -> DataFrame:
    """(point, x, y): Gaussian kernel density with Scott's bandwidth, scaled to
    the counts of a `bins`-bin histogram.  Equal values combine first; each
    distinct value then adds to `points` partial sums before the shuffle."""
    c = q(column).cast("double")
    n, std, lo, hi = df.agg(F.count(c), F.stddev_samp(c), F.min(c), F.max(c)).first()
    if not n or not std:
        return df.sparkSession.createDataFrame([], "point long, x double, y double")
    h = std * n ** (-1.0 / 5.0)
    step = (hi - lo) / (points - 1)
    scale = n * ((hi - lo) / bins) / (n * h * (2 * 3.141592653589793) ** 0.5)
    values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    x = F.lit(lo) + F.col("point") * F.lit(step)
    z = (x - F.col("v")) / F.lit(h)
    return (
        values.select("v", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point"))
        .groupBy("point")
        .agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("s"))
        .select("point", x.alias("x"), (F.col("s") * F.lit(scale)).alias("y"))
    )


def target_distribution(df: DataFrame, target: str, task: str, bins: int = 50) -> DataFrame:
    """Class counts in class order, or a histogram with mean and median."""
    if task == "classification":
        return (
            df.where(q(target).isNotNull())
            .groupBy(q(target).cast("string").alias("class"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy("class")
        )
    mean = df.agg(F.avg(q(target).cast("double"))).first()[0]
    median = exact_quantiles(df, [target], [0.5])[target][0]
    return (
        histogram(df, [target], bins)
        .drop("column_name")
        .withColumns({"mean": F.lit(mean).cast("double"), "median": F.lit(median).cast("double")})
    )
