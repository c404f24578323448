"""Isolation forest: trees grown in parallel on small samples, scored in place."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..dist import exact_quantiles, numeric_columns, q
from ..session import cut_lineage, spread

TREE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    """Nodes (node, feature, cut, left, right, length); leaves have feature -1."""
    nodes: list[tuple] = []
    stack = [(0, np.arange(len(x)), 0)]
    used = 1
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= max_depth or len(spread) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        nodes.append((node, f, cut, used, used + 1, 0.0))
        stack += [(used, rows[below], depth + 1), (used + 1, rows[~below], depth + 1)]
        used += 2
    return sorted(nodes)


def tree_samples(df: DataFrame, columns: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """Up to `sample` rows for every tree, drawn by a hash of the row.

    The hash covers the cells and, among equal rows, the number of the copy, so
    the draw follows the rows alone and not their partitions.  One rule at any
    size: a row is offered to the trees whose hash of it is among the lowest
    2 * sample / n; ranks keep the first `sample` of each tree, which Spark
    prunes before the shuffle.
    """
    n = df.count()
    limit = int(min(1.0, 2 * sample / max(n, 1)) * (1 << 40))
    cells = df.select(F.array(*[q(c).cast("double") for c in columns]).alias("x"))
    copies = cells.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rows = copies.select("x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    rows = rows.select("x", F.xxhash64("x", "copy").alias("h"))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    mine = F.filter(every, lambda t: F.pmod(F.xxhash64("h", t, F.lit(seed)), F.lit(1 << 40)) < limit)
    drawn = rows.select("x", "h", F.explode(mine).alias("tree"))
    drawn = drawn.withColumn("draw", F.xxhash64("h", "tree", F.lit(seed)))
    order = Window.partitionBy("tree").orderBy("draw", "x")
    return drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("tree", "x")


def fit_forest(df: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> dict:
    """Arrays of all nodes: at most trees * (2 * sample - 1) of them."""
    filled = df.na.drop(subset=list(columns))
    depth = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        rows = np.vstack(pdf["x"].to_numpy())
        rows = rows[np.lexsort(rows.T)]  # order of arrival must not matter
        nodes = grow_tree(rows, rng, depth)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")])

    nodes = tree_samples(filled, columns, trees, sample, seed).groupBy("tree").applyInPandas(grow, TREE_SCHEMA).toPandas()
    forest = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    return {
        "trees": [
            {c: g[c].to_numpy() for c in ("feature", "cut", "left", "right", "length")} for g in forest
        ],
        "norm": average_path(min(sample, max(filled.limit(sample).count(), 2))),
        "depth": depth,
    }


def anomaly_score(spark, forest: dict, columns: Sequence[str]):
    """Column of scores in (0, 1), higher is more isolated; NULL cells count as 0."""
    # one table for all trees; a leaf is its own child, so that every row takes the same steps
    starts, tables, first = [], [], 0
    for t in forest["trees"]:
        size = len(t["feature"])
        inner, own = t["feature"] >= 0, np.arange(size)
        child = np.stack([np.where(inner, t["left"], own), np.where(inner, t["right"], own)], axis=1) + first
        tables.append((np.maximum(t["feature"], 0), np.where(inner, t["cut"], np.inf), child.ravel(), t["length"]))
        starts.append(first)
        first += size
    nodes = [np.concatenate(part) for part in zip(*tables)] if tables else [np.zeros(0)] * 4
    shared = spark.sparkContext.broadcast((starts, nodes, forest["norm"], forest["depth"]))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        starts, (feature, cut, child, length), norm, depth = shared.value
        m = np.nan_to_num(np.vstack(x.to_numpy()).astype(float))
        flat, base = m.ravel(), np.arange(len(m)) * m.shape[1]
        total = np.zeros(len(m))
        for start in starts:
            at = np.full(len(m), start)
            for _ in range(depth):
                at = child[2 * at + (flat[base + feature[at]] > cut[at])]
            total += length[at]
        mean = total / max(len(starts), 1)
        return pd.Series(2.0 ** (-mean / max(norm, 1e-12)))

    return score(F.array(*[F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in columns]))


def flag_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = 0.1,
    trees: int = 100,
    seed: int = 42,
) -> DataFrame:
    """Add `is_outlier`: the `contamination` share of rows that isolate fastest.
    With two numeric columns or fewer the table is returned unchanged."""
    columns = list(columns if columns is not None else numeric_columns(df))
    if len(columns) <= 2:
        return df
    forest = fit_forest(df, columns, trees=trees, seed=seed)
    n = df.count()
    df = spread(df, n)
    # written once: each pass of the quantile and the result read it
    scored = cut_lineage(df.withColumn("_score", anomaly_score(df.sparkSession, forest, columns)))
    limit = exact_quantiles(scored.select("_score"), ["_score"], [1.0 - contamination])["_score"][0]
    return scored.withColumn("is_outlier", F.col("_score") > F.lit(limit)).drop("_score")
