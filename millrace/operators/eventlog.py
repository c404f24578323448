"""Queries over an event log.

Columns: event_id, ts, session_id, event_type, source, level, message,
duration_ms, agent.  All functions but the ranked ones also accept a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def newest_per(events: DataFrame, key: str, keep: int) -> DataFrame:
    """The newest `keep` rows per key.  Spark prunes each partition to `keep`
    rows per key before the shuffle, so a hot key stays small."""
    order = Window.partitionBy(key).orderBy(*newest_first())
    return events.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


def newest_per_session(events: DataFrame, keep: int = 1000) -> DataFrame:
    return newest_per(events, "session_id", keep)


def live_sessions(events: DataFrame, ttl_seconds: int = 3600, as_of=None) -> DataFrame:
    """Events of sessions whose last event is at most `ttl` old at `as_of`
    (default: the newest event)."""
    last = events.groupBy("session_id").agg(F.max("ts").alias("last_ts"))
    if as_of is None:
        as_of = events.agg(F.max("ts")).first()[0]
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    return events.join(last.where(F.col("last_ts") >= limit).select("session_id"), "session_id", "left_semi")


def recent(events: DataFrame, session_id=None, types: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    if session_id is not None:
        events = events.where(F.col("session_id") == F.lit(session_id))
    if types:
        events = events.where(F.col("event_type").isin(*types))
    return events.orderBy(*newest_first()).limit(limit)


def running_counts(events: DataFrame) -> DataFrame:
    """(kind, value, n): total and counts by level, source and type."""
    keys = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")),
        *[
            F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
            for k, c in (("level", "level"), ("source", "source"), ("type", "event_type"))
        ],
    )
    return events.select(F.inline(keys)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def search(
    events: DataFrame,
    levels: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    text: str | None = None,
) -> DataFrame:
    """Filter by level, source and case-insensitive text in message, source or type."""
    if levels:
        events = events.where(F.col("level").isin(*levels))
    if sources:
        events = events.where(F.col("source").isin(*sources))
    if text:
        word = F.lit(text.lower())
        hit = F.lit(False)
        for c in ("message", "source", "event_type"):
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), word), F.lit(False))
        events = events.where(hit)
    return events


def mean_durations(events: DataFrame) -> DataFrame:
    """(event_type, mean_ms): missing durations as 0, over the events of the type."""
    return events.groupBy("event_type").agg(F.avg(F.coalesce("duration_ms", F.lit(0.0))).alias("mean_ms"))


def mean_duration_overall(events: DataFrame) -> DataFrame:
    """Known durations summed over all events."""
    return events.agg(
        F.try_divide(F.sum(F.coalesce("duration_ms", F.lit(0.0))), F.count(F.lit(1))).alias("mean_ms")
    )


def status_of(event_type: Column) -> Column:
    return (
        F.when(F.contains(event_type, F.lit("error")), "error")
        .when(F.contains(event_type, F.lit("start")), "start")
        .when(F.contains(event_type, F.lit("end")) | F.contains(event_type, F.lit("decision")), "end")
        .otherwise("other")
    )


def timeline(events: DataFrame, n: int = 20) -> DataFrame:
    return (
        events.orderBy(*newest_first())
        .limit(n)
        .select(
            "event_id",
            F.date_format("ts", "HH:mm:ss").alias("time"),
            status_of(F.col("event_type")).alias("status"),
            F.coalesce("agent", F.lit("System")).alias("agent"),
            F.when(F.col("duration_ms").isNull(), "-")
            .otherwise(F.format_string("%.0fms", "duration_ms"))
            .alias("duration"),
        )
    )


def last_per_type(events: DataFrame, n: int = 10) -> DataFrame:
    return newest_per(events, "event_type", n)


def distribution(events: DataFrame) -> DataFrame:
    """(kind, value, n) over event types and agents."""
    long = events.select(
        F.col("event_type").cast("string").alias("type"), F.coalesce("agent", F.lit("System")).alias("agent")
    ).unpivot([], ["type", "agent"], "kind", "value")
    return long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def class_counts(events: DataFrame, parts: Sequence[str] = ("llm", "tool", "error")) -> DataFrame:
    """How many events have each word in their type."""
    return events.agg(
        *[F.count(F.when(F.contains(F.lower("event_type"), F.lit(p)), 1)).alias(f"{p}_events") for p in parts]
    )


def preview(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def outcome_type(error: Column, decision: Column) -> Column:
    return F.when(error.isNotNull(), "agent_error").when(decision.isNotNull(), "agent_decision").otherwise("agent_end")


def hourly_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling counts by event time; on a stream, set a watermark first."""
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )
