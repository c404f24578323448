"""Split and cross-validation queries (V1-V6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import split
from .base import query, rounded, table

ORDER = "ORDER BY md5('42:' || o_orderkey)"
CV_SCORES = """scores AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, 'accuracy' AS metric, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS value FROM orders GROUP BY 1
UNION ALL SELECT CAST(o_orderkey % 5 AS INTEGER), 'f1', avg(CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END) FROM orders GROUP BY 1)"""


def cv_scores(spark, d):
    base = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 5).cast("int").alias("fold"))
    rules = {"accuracy": F.col("o_totalprice") > 100000, "f1": F.col("o_custkey") % 3 == 0}
    wide = base.agg(*[F.avg(F.when(r, 1.0).otherwise(0.0)).alias(m) for m, r in rules.items()])
    return wide.unpivot(["fold"], list(rules), "metric", "value")


@query("v1_train_test", f"SELECT o_orderkey, row_number() OVER ({ORDER}) <= floor(count(*) OVER () * 0.2) AS is_test FROM orders")
def v1(spark, d):
    return split.mark_test(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "is_test")


@query("v1_split_sizes", "SELECT CAST(floor(count(*) * 0.8) AS BIGINT) AS train_rows, CAST(floor(count(*) * 0.2) AS BIGINT) AS test_rows FROM orders")
def v1b(spark, d):
    return split.split_sizes(table(spark, d, "orders"))


@query("v2_stratified_split", f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus {ORDER}) <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders")
def v2(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.mark_test(df, "o_orderkey", stratify="o_orderstatus")


@query("v3_folds", f"SELECT o_orderkey, CAST(((row_number() OVER ({ORDER}) - 1) * 5) // count(*) OVER () AS INTEGER) AS fold FROM orders")
def v3(spark, d):
    return split.mark_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("v4_stratified_folds", f"SELECT o_orderkey, o_orderstatus, CAST(((row_number() OVER (PARTITION BY o_orderstatus {ORDER}) - 1) * 5) // count(*) OVER (PARTITION BY o_orderstatus) AS INTEGER) AS fold FROM orders")
def v4(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.mark_folds(df, "o_orderkey", stratify="o_orderstatus")


@query("v6_fold_summary", f"WITH {CV_SCORES} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS folds, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci_low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(value)), 6) AS ci_high FROM scores GROUP BY 1")
def v6(spark, d):
    return rounded(split.fold_score_summary(cv_scores(spark, d)))
