"""Event-log queries (R1-R13), batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import eventlog
from ...streaming import events as streaming
from .base import query, rounded, table

LOG_SQL = """WITH log AS (SELECT event_id, ts, user_id AS session_id, event_type, event_type AS source, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level,
 props AS message, CASE WHEN event_id % 4 <> 0 THEN value END AS duration_ms, 'agent' || (user_id % 4) AS agent FROM events)
"""
LAST = "ORDER BY ts DESC, event_id DESC"


def as_log(df):
    kind = F.col("event_type")
    return df.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("session_id"),
        "event_type",
        kind.alias("source"),
        F.when(kind == "error", "error").when(kind == "signup", "warning").otherwise("info").alias("level"),
        F.col("props").alias("message"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("duration_ms"),
        F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string")).alias("agent"),
    )


def log(spark, d):
    return as_log(table(spark, d, "events"))


def log_stream(spark, d):
    # a glob, so that the table may be one file or a folder of files
    schema = table(spark, d, "events").schema
    return as_log(streaming.read_stream(spark, f"{d}/events*.parquet", schema))


def newest_sql(keep):
    return LOG_SQL + f"SELECT event_id, session_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id {LAST}) AS r FROM log) WHERE r <= {keep}"


@query("r1_newest_per_session", newest_sql(1000))
def r1(spark, d):
    return eventlog.newest_per_session(log(spark, d)).select("event_id", "session_id", "event_type")


@query("r1_newest_per_session_stream", newest_sql(1000))
def r1b(spark, d):
    events = log(spark, d)
    stream, delay = streaming.ordered_replay(events)
    groups = max(64, events.count() // 8192)
    kept = streaming.run_to_table(streaming.newest_candidates(stream, delay=delay, groups=groups), "append")
    return eventlog.newest_per_session(kept).select("event_id", "session_id", "event_type")


@query("r2_live_sessions", LOG_SQL + "SELECT event_id, session_id FROM (SELECT *, max(ts) OVER (PARTITION BY session_id) AS last FROM log) WHERE last >= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR")
def r2(spark, d):
    return eventlog.live_sessions(log(spark, d)).select("event_id", "session_id")


@query("r3_recent_of_types", LOG_SQL + f"SELECT event_id, event_type FROM log WHERE event_type IN ('error', 'purchase') {LAST} LIMIT 100")
def r3(spark, d):
    return eventlog.recent(log(spark, d), types=["error", "purchase"]).select("event_id", "event_type")


@query("r4_push_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def r4(spark, d):
    from ...session import scratch_path

    out = scratch_path(spark, "pushed")

    def receive(df, batch):
        df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/part={batch}")

    streaming.push_to(log_stream(spark, d), [receive])
    return spark.read.parquet(f"{out}/part=*").groupBy("event_type").agg(F.sum("n").alias("n"))


COUNTS = LOG_SQL + "SELECT CASE WHEN grouping(level) = 0 THEN 'level' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(event_type) = 0 THEN 'type' ELSE 'total' END AS kind, coalesce(level, source, event_type, 'all') AS value, count(*) AS n FROM log GROUP BY GROUPING SETS ((level), (source), (event_type), ())"


@query("r5_running_counts", COUNTS)
def r5(spark, d):
    return eventlog.running_counts(log(spark, d))


@query("r5_running_counts_stream", COUNTS)
def r5b(spark, d):
    return streaming.run_to_table(eventlog.running_counts(log_stream(spark, d)), "complete")


@query("r6_search", LOG_SQL + "SELECT event_id, level FROM log WHERE level IN ('error', 'info') AND (lower(message) LIKE '%7%' OR source LIKE '%7%' OR event_type LIKE '%7%')")
def r6(spark, d):
    return eventlog.search(log(spark, d), levels=["error", "info"], text="7").select("event_id", "level")


@query("r7_mean_duration", LOG_SQL + "SELECT event_type, round(avg(coalesce(duration_ms, 0)), 4) AS mean_ms FROM log GROUP BY 1")
def r7(spark, d):
    return rounded(eventlog.mean_durations(log(spark, d)), 4)


@query("r7_mean_duration_overall", LOG_SQL + "SELECT round(sum(coalesce(duration_ms, 0)) / count(*), 4) AS mean_ms FROM log")
def r7b(spark, d):
    return rounded(eventlog.mean_duration_overall(log(spark, d)), 4)


@query("r8_timeline", LOG_SQL + f"""SELECT event_id, strftime(ts, '%H:%M:%S') AS time, CASE WHEN event_type LIKE '%error%' THEN 'error' WHEN event_type LIKE '%start%' THEN 'start' WHEN event_type LIKE '%end%' OR event_type LIKE '%decision%' THEN 'end' ELSE 'other' END AS status,
agent, CASE WHEN duration_ms IS NULL THEN '-' ELSE format('{{:.0f}}ms', duration_ms) END AS duration FROM log {LAST} LIMIT 20""")
def r8(spark, d):
    return eventlog.timeline(log(spark, d))


@query("r9_last_per_type", LOG_SQL + f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type {LAST}) AS r FROM log) WHERE r <= 10")
def r9(spark, d):
    return eventlog.last_per_type(log(spark, d)).select("event_id", "event_type")


@query("r10_distribution", LOG_SQL + "SELECT 'type' AS kind, event_type AS value, count(*) AS n FROM log GROUP BY ALL UNION ALL SELECT 'agent', agent, count(*) FROM log GROUP BY ALL")
def r10(spark, d):
    return eventlog.distribution(log(spark, d))


@query("r10_class_counts", "SELECT count(*) FILTER (WHERE event_type LIKE '%llm%') AS llm_events, count(*) FILTER (WHERE event_type LIKE '%tool%') AS tool_events, count(*) FILTER (WHERE event_type LIKE '%error%') AS error_events FROM events")
def r10b(spark, d):
    return eventlog.class_counts(log(spark, d))


@query("r11_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def r11(spark, d):
    return table(spark, d, "documents").select("doc_id", eventlog.preview(F.col("text")).alias("preview"))


@query("r12_outcome_type", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'agent_error' WHEN event_type = 'purchase' THEN 'agent_decision' ELSE 'agent_end' END AS outcome FROM events")
def r12(spark, d):
    kind = F.col("event_type")
    outcome = eventlog.outcome_type(F.when(kind == "error", F.col("message")), F.when(kind == "purchase", F.col("message")))
    return log(spark, d).select("event_id", outcome.alias("outcome"))


@query("r13_hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r13(spark, d):
    return eventlog.hourly_counts(log(spark, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("r13_distinct_events_stream", "SELECT event_id, event_type FROM events")
def r13b(spark, d):
    stream, delay = streaming.ordered_replay(log(spark, d))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = streaming.drop_repeats(twice, delay)
    return streaming.run_to_table(once.select("event_id", "event_type"), "append")
