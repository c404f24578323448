"""Splits and folds as filters on a seeded hash of the row key.

Membership depends only on (seed, key), so it survives repartitioning and lost
executors; exact sizes come from hash cut-offs found by `dist.hash_cuts`, and
no row moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import hash_cut_table, hash_cuts, hash_key, q

FOLD = "fold"
BROADCAST_CLASSES = 100_000


def _share(x: float) -> tuple[int, int]:
    return round(x * 1_000_000), 1_000_000


def _with_class_cuts(df: DataFrame, key: str, seed: int, shares: list, label: str) -> DataFrame:
    """Add `_cuts`, the hash cuts of the row's class, from a table of one row per class."""
    typed = df.withColumn("_label", q(label).cast("string"))
    table = hash_cut_table(typed, key, seed, shares, by="_label", rounding="ceil")
    table = F.broadcast(table) if table.count() <= BROADCAST_CLASSES else table
    same = F.col("_label").eqNullSafe(F.col("_class"))
    return typed.join(table, same, "left").drop("_label", "_class")


def mark_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add boolean `is_test`: floor(n * share) rows, or ceil of it per class."""
    h = hash_key(key, seed)
    if stratify is None:
        cut = hash_cuts(df, key, seed, [_share(test_size)])[None][0]
        return df.withColumn("is_test", h <= F.lit(cut))
    marked = _with_class_cuts(df, key, seed, [_share(test_size)], stratify)
    return marked.withColumn("is_test", h <= F.col("_cuts")[0]).drop("_cuts")


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None
) -> tuple[DataFrame, DataFrame]:
    marked = mark_test(df, key, test_size, seed, stratify)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def split_sizes(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """The sizes alone, both rounded down."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        (F.col("n") * F.lit(1 - test_size)).cast("long").alias("train_rows"),
        (F.col("n") * F.lit(test_size)).cast("long").alias("test_rows"),
    )


def _fold_number(h: Column, cuts: list[Column]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(h > c, 1).otherwise(0)
    return out.cast(T.IntegerType())


def mark_folds(
    df: DataFrame, key: str, folds: int = 5, seed: int = 42, stratify: str | None = None, output: str = FOLD
) -> DataFrame:
    """Add the fold number; fold sizes differ by at most one row (per class)."""
    h = hash_key(key, seed)
    shares = [(i, folds) for i in range(1, folds)]
    if stratify is None:
        cuts = hash_cuts(df, key, seed, shares, rounding="ceil")[None]
        return df.withColumn(output, _fold_number(h, [F.lit(c) for c in cuts]))
    marked = _with_class_cuts(df, key, seed, shares, stratify)
    return marked.withColumn(output, _fold_number(h, [F.col("_cuts")[i] for i in range(folds - 1)])).drop("_cuts")


def nested_samples(df: DataFrame, key: str, shares: list[float], seed: int = 42) -> list[DataFrame]:
    """Growing samples, each containing the ones before (learning curves, halving)."""
    cuts = hash_cuts(df, key, seed, [_share(s) for s in shares])[None]
    h = hash_key(key, seed)
    return [df if s >= 1.0 else df.where(h <= F.lit(c)) for s, c in zip(shares, cuts)]


def fold_score_summary(scores: DataFrame) -> DataFrame:
    """Per metric: mean, population std, 95 % interval; missing folds ignored."""
    half = F.lit(1.96) * F.col("std") / F.sqrt(F.col("folds").cast("double"))
    known = F.when(~F.isnan("value"), F.col("value"))
    return (
        scores.groupBy("metric")
        .agg(F.avg(known).alias("mean"), F.stddev_pop(known).alias("std"), F.count(known).alias("folds"))
        .where("folds > 0")
        .withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
    )
