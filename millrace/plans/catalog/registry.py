"""Experiment, dataset and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import registry
from .base import query, rounded, table, union_sql

EXP_SQL = """WITH exp AS (SELECT o_orderkey AS id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 9000) END AS completed_at, o_orderpriority AS model,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 500000 END AS accuracy FROM orders)
"""
SHOW = "id, session_id, status, strftime(created_at, '%Y-%m-%d') AS created"


def experiments(spark, d):
    k = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("session_id"),
        F.when(done, "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(done, F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 9000)).alias("completed_at"),
        F.struct(
            F.col("o_orderpriority").alias("model"),
            F.lit("classification").alias("problem_type"),
            F.create_map(
                F.lit("accuracy"), F.when(k % 13 != 0, F.col("o_totalprice") / 500000),
                F.lit("f1"), F.col("o_custkey") / 10000.0,
            ).alias("metrics"),
        ).alias("results"),
        F.when(k % 2 == 0, F.create_map(F.lit("depth"), (k % 7).cast("string"), F.lit("rate"), F.lit("0.1")))
        .otherwise(F.create_map(F.lit("depth"), (k % 7).cast("string"), F.lit("trees"), F.lit("100")))
        .alias("params"),
    )


def sessions(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"))


def messages(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content"))


def shown(df, *extra):
    return df.select("id", "session_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), *extra)


@query("x1_list_experiments", EXP_SQL + f"SELECT {SHOW}, (SELECT count(*) FROM exp WHERE status = 'completed') AS total FROM exp WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def x1(spark, d):
    return shown(registry.list_experiments(experiments(spark, d), status="completed", skip=20, limit=50), "total")


@query("x1_experiments_of_session", EXP_SQL + f"SELECT {SHOW}, (SELECT count(*) FROM exp WHERE session_id = 7) AS total FROM exp WHERE session_id = 7 ORDER BY created_at DESC, id LIMIT 100")
def x1b(spark, d):
    return shown(registry.list_experiments(experiments(spark, d), session_id=7), "total")


@query("x2_experiments_of_user", EXP_SQL + f"SELECT {SHOW} FROM exp WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = session_id AND c_nationkey = 3)")
def x2(spark, d):
    return shown(registry.of_user(experiments(spark, d), sessions(spark, d), 3))


@query("x2_experiments_with_user", EXP_SQL + f"SELECT {SHOW}, c_nationkey AS user_id FROM exp JOIN customer ON c_custkey = session_id")
def x2b(spark, d):
    return shown(registry.with_user(experiments(spark, d), sessions(spark, d)), "user_id")


@query("x3_experiment_detail", EXP_SQL + f""", runs AS (SELECT l_orderkey, round(sum(l_quantity), 4) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT {SHOW}, q AS quantity, CAST(n AS VARCHAR) AS lines FROM exp LEFT JOIN runs ON l_orderkey = id""")
def x3(spark, d):
    runs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.create_map(F.lit("quantity"), F.sum("l_quantity")).alias("metrics"),
        F.create_map(F.lit("lines"), F.count(F.lit(1)).cast("string")).alias("params"))
    df = registry.experiment_detail(experiments(spark, d), runs)
    return rounded(shown(df, F.col("run_metrics")["quantity"].alias("quantity"), F.col("run_params")["lines"].alias("lines")), 4)


IDS = [1, 4, 2, 13, 7]


@query("x4_compare_metrics", EXP_SQL + ", m AS (SELECT id, model, 'accuracy' AS metric, accuracy AS value FROM exp UNION ALL SELECT id, model, 'f1', session_id / 10000.0 FROM exp) SELECT id, model, metric, round(value, 6) AS value FROM m WHERE id IN (1, 4, 2, 13, 7)")
def x4(spark, d):
    return rounded(registry.compare_metrics(experiments(spark, d), IDS))


@query("x4_best_experiment", EXP_SQL + "SELECT id, model, 'accuracy' AS metric, round(accuracy, 6) AS value FROM exp WHERE id IN (1, 4, 2, 13, 7) AND accuracy IS NOT NULL ORDER BY accuracy DESC LIMIT 1")
def x4b(spark, d):
    return rounded(registry.best_of(experiments(spark, d), IDS, "accuracy"))


@query("x5_sort_by_performance", EXP_SQL + "SELECT id, round(coalesce(accuracy, 0), 9) AS accuracy FROM exp ORDER BY coalesce(accuracy, 0) DESC, id")
def x5(spark, d):
    df = registry.sort_experiments(experiments(spark, d), "performance")
    return rounded(df.select("id", F.coalesce(F.col("results.metrics")["accuracy"], F.lit(0.0)).alias("accuracy")), 9)


@query("x6_summary", EXP_SQL + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running,
round(avg(coalesce(accuracy, 0)) FILTER (WHERE status = 'completed'), 6) AS mean_accuracy, round(avg(accuracy) FILTER (WHERE accuracy <> 0), 6) AS mean_known_accuracy FROM exp""")
def x6(spark, d):
    return rounded(registry.summarize(experiments(spark, d)))


@query("x7_duration_text", EXP_SQL + """SELECT id, CASE WHEN completed_at IS NULL THEN 'N/A' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE format('{:.1f}h', floor(s / 360.0 + 0.5) / 10) END AS duration
FROM (SELECT *, CAST(epoch(completed_at) - epoch(created_at) AS BIGINT) AS s FROM exp)""")
def x7(spark, d):
    df = experiments(spark, d)
    return df.select("id", registry.duration_text(F.col("created_at"), F.col("completed_at")).alias("duration"))


@query("x8_counts", EXP_SQL + "SELECT 'model' AS kind, model AS value, count(*) AS n FROM exp GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM exp GROUP BY ALL")
def x8(spark, d):
    return registry.counts_by(experiments(spark, d))


@query("x9_compare_params", union_sql(["SELECT '" + p + "' AS param, " + ", ".join(
    f"(SELECT CASE WHEN '{p}' = 'depth' THEN CAST(o_orderkey % 7 AS VARCHAR) WHEN '{p}' = 'rate' AND o_orderkey % 2 = 0 THEN '0.1' WHEN '{p}' = 'trees' AND o_orderkey % 2 = 1 THEN '100' END FROM orders WHERE o_orderkey = {i}) AS \"{i}\"" for i in IDS)
    for p in ("depth", "rate", "trees")]))
def x9(spark, d):
    return registry.compare_params(experiments(spark, d), IDS)


@query("x10_accuracy_trend", EXP_SQL + "SELECT strftime(created_at, '%Y-%m-%d') AS day, model, round(avg(accuracy), 9) AS accuracy, count(*) AS n FROM exp WHERE accuracy IS NOT NULL GROUP BY ALL")
def x10(spark, d):
    return rounded(registry.accuracy_trend(experiments(spark, d)), 9)


@query("x11_file_types", "SELECT upper(lang) AS file_type, count(*) AS n FROM documents GROUP BY 1")
def x11(spark, d):
    files = table(spark, d, "documents").select(F.concat("source", F.lit(".v1."), "lang").alias("name"))
    return registry.file_types(files, "name")


@query("x12_list_datasets", "SELECT page_id AS id, url AS filename, (SELECT count(*) FROM pages) AS total FROM pages ORDER BY page_id DESC LIMIT 25 OFFSET 10")
def x12(spark, d):
    data = table(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("filename"), F.timestamp_seconds(F.col("page_id") * 3600).alias("created_at"))
    return registry.list_datasets(data, 10, 25).select("id", "filename", "total")


@query("x13_session_overview", "SELECT c_custkey AS id, count(conv_id) AS messages, max(turn) AS updated_at FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY 1")
def x13(spark, d):
    return registry.session_overview(sessions(spark, d), messages(spark, d))


@query("x13_message_order", "SELECT conv_id AS session_id, turn AS created_at, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def x13b(spark, d):
    return registry.number_messages(messages(spark, d)).drop("content")


DELETED = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


@query("x14_cascade_delete", f"""SELECT 'sessions' AS child, count(*) AS n FROM customer WHERE c_custkey NOT IN {DELETED}
UNION ALL SELECT 'experiments', count(*) FROM orders WHERE o_custkey NOT IN {DELETED}
UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id NOT IN {DELETED}""")
def x14(spark, d):
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    left = registry.cascade_delete(sessions(spark, d), {"experiments": experiments(spark, d), "messages": messages(spark, d)}, gone)
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("child"), "n")
        out = row if out is None else out.unionByName(row)
    return out
