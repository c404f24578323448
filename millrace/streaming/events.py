"""Structured Streaming forms of the event-log operators."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import scratch_path

KEEP = 1000
TTL_SECONDS = 3600


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """File source; `max_files` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(
    stream: DataFrame,
    mode: str,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    timeout: int | None = None,
    progress: list[dict] | None = None,
) -> int:
    """Process everything present, batch by batch, and stop; no time limit
    unless one is given.  Returns how many rows came too late for a watermark
    (as far back as Spark keeps progress) and warns if there were any.
    `progress` gets batch, rows read, rows held in state and late rows of each batch."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each_batch)
        .start()
    )
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream did not finish in {timeout} s")
        late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
        if progress is not None:
            for p in query.recentProgress:
                held = sum(s["numRowsTotal"] for s in p["stateOperators"])
                dropped = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
                progress.append({"batch": p["batchId"], "rows": p["numInputRows"], "state_rows": held, "late": dropped})
        if late:
            warnings.warn(f"{late} rows came later than the watermark and were dropped", stacklevel=2)
        return late
    finally:
        query.stop()


def run_to_table(stream: DataFrame, mode: str, progress: list[dict] | None = None) -> DataFrame:
    """Run to the end and read the result back.

    Append output collects in one folder.  Complete output is one folder per
    batch and the last is the result.  Folders carry the batch number, so a
    batch that is replayed after a failure overwrites itself.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    schema = stream.schema
    last = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        last.append(batch)

    run_available(stream, mode, write, progress=progress)
    last = sorted(set(last))
    if not last:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if mode == "complete":
        return reader.parquet(f"{out}/batch={last[-1]}")
    return reader.parquet(*[f"{out}/batch={b}" for b in last])


def replay_delay(events: DataFrame, time: str = "ts") -> str:
    """Watermark delay with which a replay of `events` drops no row, whatever
    the order of its files: the time between the first and the last event."""
    first, last = events.agg(F.min(time), F.max(time)).first()
    return f"{int((last - first).total_seconds()) + 1 if first is not None else 1} seconds"


def ordered_replay(events: DataFrame, time: str = "ts", slices: int = 8, files: int = 4) -> tuple[DataFrame, str]:
    """(stream, delay): a bounded table as a stream in the order of time, and the
    watermark delay with which it loses nothing.

    The table is cut at quantiles of the time into slices that are written one
    after the other; a file source hands files out by age, so a batch of
    `files` files is about a slice and no row is later than the widest slice.
    State that is kept for the delay holds some slices of the table, where
    a replay in any order needs a delay as long as the table (`replay_delay`).
    Rows without a time come with the first slice.
    """
    spark, micros = events.sparkSession, F.unix_micros(time)
    path = scratch_path(spark, "replay")
    shares = [i / slices for i in range(1, slices)]
    first, last, cuts = events.agg(F.min(micros), F.max(micros), F.percentile_approx(micros, shares, 1000)).first()
    cuts = sorted(set(cuts or []))
    ends = [None, *cuts, None]
    for low, high in zip(ends, ends[1:]):
        inside = F.lit(True) if high is None else micros < high
        inside = inside | micros.isNull() if low is None else inside & (micros >= low)
        events.where(inside).repartition(files).write.mode("append").parquet(path)
    edges = [first or 0, *cuts, last or 0]
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    return read_stream(spark, path, events.schema, files), f"{math.ceil(widest / 1e6) + 1} seconds"


def push_to(
    stream: DataFrame, subscribers: list[Callable[[DataFrame, int], None]], checkpoint: str | None = None
) -> None:
    """Hand every new micro-batch to all subscribers; one that fails does not
    keep the others from theirs.  The batch then counts as failed: it is raised
    after all were called, and a run from the same `checkpoint` hands the batch
    out again, with the same number, by which subscribers overwrite."""

    def notify(df: DataFrame, batch: int) -> None:
        kept, failed = df.persist(), []
        try:
            for i, call in enumerate(subscribers):
                try:
                    call(kept, batch)
                except Exception as e:
                    failed.append((i, e))
        finally:
            kept.unpersist()
        if failed:
            names = ", ".join(f"{i}: {e}" for i, e in failed)
            raise RuntimeError(f"subscribers failed on batch {batch}: {names}") from failed[0][1]

    run_available(stream, "append", notify, checkpoint)


def newest_candidates(
    stream: DataFrame,
    keep: int = KEEP,
    ttl_seconds: int = TTL_SECONDS,
    salts: int = 16,
    delay: str = "10 minutes",
    groups: int = 1024,
) -> DataFrame:
    """Stream of events that were among the newest `keep` of their session when seen.

    Events go to one of `groups` groups by a hash of session and salt, so a hot
    session is spread over `salts` of them, and a batch costs a call for each
    group, not for each session.  State of a group is, for each session in it, the
    newest `keep` (ts, event_id); a session leaves after `ttl` of event time
    without events.  The newest `keep` of a session are always among the newest
    `keep` of its groups, so `eventlog.newest_per_session` over the output is the
    exact list.  `groups` should grow with the events that are held, so that one
    group's stay few (some thousands).
    """
    columns = ["event_id", "ts", "session", "event_type"]
    # one text for each session, also for null; never null itself
    text = F.coalesce(F.concat(F.lit("="), F.col("session_id").cast("string")), F.lit(""))
    kind = stream.schema["session_id"].dataType
    events = stream.select("event_id", "ts", text.alias("session"), "event_type")
    schema = events.schema
    ids = T.ArrayType(schema["event_id"].dataType)
    state = T.StructType(
        [T.StructField("sessions", T.ArrayType(T.StringType())), T.StructField("micros", T.ArrayType(T.LongType())), T.StructField("ids", ids)]
    )
    ttl = ttl_seconds * 1_000_000

    def update(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        watermark = group.getCurrentWatermarkMs()
        late = group.hasTimedOut
        held = pd.DataFrame(dict(zip(("session", "micros", "event_id"), map(list, group.get))) if group.exists else {"session": [], "micros": [], "event_id": []})
        fresh = None if late else pd.concat(list(frames), ignore_index=True)
        every = held
        if fresh is not None:
            micros = fresh["ts"].astype("datetime64[us]").astype("int64")
            seen = pd.DataFrame({"session": fresh["session"], "micros": micros, "event_id": fresh["event_id"]})
            every = pd.concat([held, seen], ignore_index=True) if len(held) else seen
        kept = every.drop_duplicates().sort_values(["session", "micros", "event_id"], ascending=[True, False, False])
        kept = kept[kept.groupby("session").cumcount() < keep]
        if fresh is not None:
            mine = pd.MultiIndex.from_frame(fresh[["session", "event_id"]])
            yield fresh.loc[mine.isin(pd.MultiIndex.from_frame(kept[["session", "event_id"]])), columns]
        newest = kept.groupby("session")["micros"].transform("max") + ttl
        if late:  # sessions that are over leave when their group's time is up
            alive = newest > watermark * 1000
            kept, newest = kept[alive], newest[alive]
        if not len(kept):
            group.remove()
            return
        group.update((kept["session"].tolist(), kept["micros"].tolist(), kept["event_id"].tolist()))
        group.setTimeoutTimestamp(max(int(newest.min()) // 1000, watermark + 1))

    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")
    grouped = events.withWatermark("ts", delay).withColumn("group", F.pmod(F.xxhash64("session", salt), F.lit(groups)).cast("int"))
    found = grouped.groupBy("group").applyInPandasWithState(update, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    session = F.when(F.col("session") != "", F.substring("session", 2, 2**31 - 1)).cast(kind)
    return found.select("event_id", "ts", session.alias("session_id"), "event_type")


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    from ..operators.eventlog import hourly_counts

    return hourly_counts(stream.withWatermark("ts", delay), width)


def drop_repeats(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First copy of each event_id within the watermark, ids of any type.

    Ids leave the state when the watermark has passed them by `delay`.  Rows
    later than `delay` behind the newest event are dropped and counted
    (`run_available`).  A bounded replay takes stream and delay from
    `ordered_replay`, or its delay from the data (`replay_delay`), and loses nothing.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
