"""Registration of named queries and their SQL oracles, and shared inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Round every double (or the named columns), for comparison with SQL."""
    names = [c for c, t in df.dtypes if t in ("double", "float")] if only is None else list(only)
    return df.select(
        *[
            (F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c)
            if c in names
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---- inputs with missing values, duplicates and outliers -------------------

DIRTY_COLUMNS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderpriority",
    "mostly_null",
    "const",
]

DIRTY_SQL = """dirty0 AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL
              WHEN o_orderkey % 97 = 0 THEN o_totalprice * 10 ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderkey % 10 = 0 THEN o_custkey END AS mostly_null,
         CAST(1 AS BIGINT) AS const
  FROM orders),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE o_orderkey % 50 = 0)"""


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(k % 7 == 0, None)
        .when(k % 97 == 0, F.col("o_totalprice") * 10)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        F.when(k % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 10 == 0, F.col("o_custkey")).alias("mostly_null"),
        F.lit(1).cast("long").alias("const"),
    )
    return base.unionAll(base.where(k % 50 == 0))


PREDS_REG_SQL = """preds AS (
  SELECT o_orderkey AS row_id, o_totalprice AS label,
         0.9 * o_totalprice + 10 * (o_custkey % 1000) AS prediction FROM orders)"""


def regression_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("label"),
        (F.lit(0.9) * F.col("o_totalprice") + F.lit(10) * (F.col("o_custkey") % 1000)).alias(
            "prediction"
        ),
    )


PREDS_CLS_SQL = """preds0 AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
         l_partkey, l_discount, l_tax FROM lineitem),
preds AS (
  SELECT CAST(label AS BIGINT) AS label,
         CAST(CASE WHEN l_partkey % 5 = 0 THEN (label + 1) % 3 ELSE label END AS BIGINT) AS prediction,
         (1 + 10 * l_discount + CASE WHEN label = 0 THEN 1 ELSE 0 END) AS w0,
         (1 + 10 * l_tax + CASE WHEN label = 1 THEN 1 ELSE 0 END) AS w1,
         (1.5 + CASE WHEN label = 2 THEN 1 ELSE 0 END) AS w2
  FROM preds0)"""


def class_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """label, prediction and a three-class probability array per lineitem."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    base = table(spark, folder, "lineitem").select(
        label.cast("long").alias("label"), "l_partkey", "l_discount", "l_tax"
    )
    y = F.col("label")
    weights = [
        1 + 10 * F.col("l_discount") + F.when(y == 0, 1).otherwise(0),
        1 + 10 * F.col("l_tax") + F.when(y == 1, 1).otherwise(0),
        F.lit(1.5) + F.when(y == 2, 1).otherwise(0),
    ]
    total = weights[0] + weights[1] + weights[2]
    return base.select(
        "label",
        F.when(F.col("l_partkey") % 5 == 0, (y + 1) % 3).otherwise(y).alias("prediction"),
        F.array(*[w / total for w in weights]).alias("probability"),
    )


PREDS_BIN_SQL = """preds AS (
  SELECT CAST(l.toxic AS BIGINT) AS label, d.n_chars / (d.n_chars + 500.0) AS score
  FROM labels l JOIN documents d USING (doc_id))"""


def binary_predictions(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    return (
        table(spark, folder, "labels")
        .join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(F.col("toxic").cast("long").alias("label"), (n / (n + 500.0)).alias("score"))
    )
