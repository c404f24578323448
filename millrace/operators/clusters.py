"""Clustering quality: silhouette, Calinski-Harabasz, Davies-Bouldin, sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import q
from ..session import kernel_tasks
from .neighbors import euclidean

BLOCK_ROWS = 1024
#: blocks of rows that a table is cut into, and the most bytes of one block's features
BLOCKS = 24
BLOCK_BYTES = 32 << 20


def _labelled(df: DataFrame, features: str, cluster: str, row_id: str) -> DataFrame:
    return df.select(
        q(row_id).alias("row_id"),
        F.transform(q(features), lambda x: x.cast("double")).alias("x"),
        q(cluster).cast("string").alias("cluster"),
    )


def _members(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, and which of them each row has (rows x names)."""
    found, codes = np.unique(names.astype(str), return_inverse=True)
    member = np.zeros((len(names), len(found)))
    member[np.arange(len(names)), codes] = 1.0
    return found, member


def _values(totals: DataFrame) -> DataFrame:
    """totals (row_id, own, cluster, total, size) -> (row_id, silhouette)."""
    same, s = F.col("own") == F.col("cluster"), F.col("size")
    a = F.max(F.when(same & (s > 1), F.col("total") / F.when(s > 1, s - 1)))
    b = F.min(F.when(~same, F.col("total") / s))
    means = totals.groupBy("row_id").agg(a.alias("a"), b.alias("b"))
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return means.select("row_id", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette(
    df: DataFrame, features: str, cluster: str, row_id: str, block_rows: int | None = None
) -> DataFrame:
    """(row_id, silhouette) with Euclidean distances, exact; ids of any type.

    The definition needs the distance of every row to every cluster's rows, so
    work is quadratic.  Rows are hashed into blocks of bounded size; one task
    handles one unordered pair of blocks as matrix products of BLOCK_ROWS rows and
    returns, for the rows of both, their distance sums to each cluster, never pairs.
    A row is shuffled once for each block, so blocks grow with the table, and what is
    shuffled is in proportion to it, until a block has BLOCK_BYTES.
    `silhouette_estimate` and `silhouette_squared` are the linear-time forms.
    """
    base = _labelled(df, features, cluster, row_id)
    kind = base.schema["row_id"].dataType.simpleString()
    sizes = base.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    n, k = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n or k < 2:
        return df.sparkSession.createDataFrame([], f"row_id {kind}, silhouette double")
    if block_rows is None:
        dims = base.agg(F.max(F.size("x"))).first()[0]
        block_rows = max(BLOCK_ROWS, min(math.ceil(n / BLOCKS), BLOCK_BYTES // (8 * max(dims or 1, 1))))
    blocks = math.ceil(n / block_rows)
    own = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    left = base.select("*", own.alias("i")).select("*", F.explode(F.sequence(F.col("i"), F.lit(blocks - 1))).alias("j"))
    right = base.select("*", own.alias("j")).select("*", F.explode(F.sequence(F.lit(0), F.col("j"))).alias("i"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "own": [], "cluster": [], "total": []})
        x, y = np.vstack(a["x"].to_numpy()), np.vstack(b["x"].to_numpy())
        (a_names, a_member), (b_names, b_member) = _members(a["cluster"].to_numpy()), _members(b["cluster"].to_numpy())
        to_b, to_a = np.zeros((len(x), len(b_names))), np.zeros((len(y), len(a_names)))
        for i in range(0, len(x), BLOCK_ROWS):
            for j in range(0, len(y), BLOCK_ROWS):
                d = euclidean(x[i : i + BLOCK_ROWS], y[j : j + BLOCK_ROWS])
                to_b[i : i + BLOCK_ROWS] += d @ b_member[j : j + BLOCK_ROWS]
                to_a[j : j + BLOCK_ROWS] += d.T @ a_member[i : i + BLOCK_ROWS]
        sides = [(a, b_names, to_b)]
        if a["i"].iloc[0] != a["j"].iloc[0]:  # a block with itself is looked at once
            sides.append((b, a_names, to_a))
        out = []
        for rows, names, total in sides:
            out.append(
                pd.DataFrame(
                    {
                        "row_id": np.repeat(rows["row_id"].to_numpy(), len(names)),
                        "own": np.repeat(rows["cluster"].to_numpy(), len(names)),
                        "cluster": np.tile(names, len(rows)),
                        "total": total.ravel(),
                    }
                )
            )
        return pd.concat(out)

    tasks = kernel_tasks(df.sparkSession)
    totals = (
        left.repartition(tasks, "i", "j")
        .groupBy("i", "j")
        .cogroup(right.repartition(tasks, "i", "j").groupBy("i", "j"))
        .applyInPandas(sums, f"row_id {kind}, own string, cluster string, total double")
        .groupBy("row_id", "own", "cluster")
        .agg(F.sum("total").alias("total"))
        .join(F.broadcast(sizes), "cluster")  # one row per cluster
    )
    return _values(totals)


def silhouette_estimate(
    df: DataFrame, features: str, cluster: str, row_id: str, rows: int = 2000, z: float = 1.96, seed: int = 42
) -> DataFrame:
    """One row (silhouette, low, high, rows): the mean over `rows` rows, the first by a seeded hash of the id,
    each compared with all rows, and the interval that holds the exact mean with the confidence of z.

    One pass in linear time; with `rows` not below the table's the value is exact.
    """
    base = _labelled(df, features, cluster, row_id)
    sizes = base.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    n, k = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    spark = df.sparkSession
    if not n or k < 2:
        return spark.createDataFrame([(None, None, None, 0)], "silhouette double, low double, high double, rows long")
    picked = base.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(rows).collect()  # bounded by rows
    x = np.array([r["x"] for r in picked])
    clusters = [r["cluster"] for r in picked]

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                y = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                names, member = _members(np.array(batch.column("cluster").to_pylist()))
                for name, column in zip(names, (euclidean(x, y) @ member).T):
                    total[name] = total.get(name, 0.0) + column
        for name, column in total.items():
            place = pa.array(np.arange(len(column)))
            yield pa.RecordBatch.from_arrays([place, pa.array([name] * len(column)), pa.array(column)], names=["i", "cluster", "total"])

    parts = base.select("x", "cluster").mapInArrow(run, "i long, cluster string, total double")
    totals = parts.groupBy("i", "cluster").agg(F.sum("total").alias("total")).join(F.broadcast(sizes), "cluster")
    owners = spark.createDataFrame(list(enumerate(clusters)), "i long, own string")
    value = _values(totals.join(F.broadcast(owners), "i").withColumnRenamed("i", "row_id"))
    m = len(picked)
    # the spread of a mean of m of n rows
    spread = F.coalesce(F.stddev("silhouette"), F.lit(0.0)) * F.lit(z * math.sqrt((1 - m / n) / m))
    out = value.agg(F.avg("silhouette").alias("silhouette"), spread.alias("e"))
    return out.select(
        "silhouette", (F.col("silhouette") - F.col("e")).alias("low"), (F.col("silhouette") + F.col("e")).alias("high"),
        F.lit(m).cast("long").alias("rows"),
    )


def silhouette_score(df: DataFrame, features: str, cluster: str, row_id: str, block_rows: int | None = None) -> DataFrame:
    return silhouette(df, features, cluster, row_id, block_rows).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Mean silhouette under squared distances, from per-cluster sums (MLlib)."""
    base = df.select(array_to_vector(q(features)).alias("features"), q(cluster).cast("double").alias("prediction"))
    value = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(base)
    return df.sparkSession.createDataFrame([(value,)], "silhouette_squared double")


def dispersion(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin; NULL with fewer than two clusters.

    Two passes: centroids (one row per cluster), then distances to them.
    """
    spark = df.sparkSession
    base = df.select(F.transform(q(features), lambda x: x.cast("double")).alias("x"), q(cluster).cast("string").alias("c"))
    head = base.select(F.size("x").alias("d")).first()
    schema = "calinski_harabasz double, davies_bouldin double"
    if head is None:
        return spark.createDataFrame([(None, None)], schema)
    dims = head["d"]
    centers = base.groupBy("c").agg(
        F.array(*[F.avg(F.col("x")[j]) for j in range(dims)]).alias("center"), F.count(F.lit(1)).alias("n")
    )
    table = centers.collect()  # one row per cluster
    k, n = len(table), sum(r["n"] for r in table)
    if k < 2 or n <= k:
        return spark.createDataFrame([(None, None)], schema)
    known = spark.createDataFrame([(r["c"], r["center"]) for r in table], "c string, center array<double>")
    squared = F.aggregate(
        F.zip_with("x", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v
    )
    spread = {
        r["c"]: (r["within"], r["mean"])
        for r in base.join(F.broadcast(known), "c")
        .withColumn("d2", squared)
        .groupBy("c")
        .agg(F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("mean"))
        .collect()
    }
    c = np.array([r["center"] for r in table])
    w = np.array([r["n"] for r in table], dtype=float)
    grand = (c * w[:, None]).sum(axis=0) / n
    between = float((w * ((c - grand) ** 2).sum(axis=1)).sum())
    within = float(sum(spread[r["c"]][0] for r in table))
    mean = np.array([spread[r["c"]][1] for r in table])
    apart = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore"):
        worst = ((mean[:, None] + mean[None, :]) / apart).max(axis=1)
    ch = 1.0 if within == 0 else between * (n - k) / (within * (k - 1))
    return spark.createDataFrame([(ch, float(worst.mean()))], schema)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(q(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def size_variation(df: DataFrame, cluster: str) -> DataFrame:
    """Standard deviation (ddof 1) over mean of the cluster sizes; empty for one cluster."""
    return (
        cluster_sizes(df, cluster)
        .agg(F.count(F.lit(1)).alias("clusters"), (F.stddev_samp("n") / F.avg("n")).alias("size_variation"))
        .where("clusters > 1")
    )


def evaluate_clustering(df: DataFrame, features: str, cluster: str, row_id: str) -> DataFrame:
    """(metric, value, ci_low, ci_high)."""
    from .metrics import to_rows, with_interval

    rows = (
        to_rows(silhouette_score(df, features, cluster, row_id))
        .unionByName(to_rows(dispersion(df, features, cluster)))
        .unionByName(to_rows(size_variation(df, cluster)))
    )
    return with_interval(rows)
