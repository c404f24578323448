"""Streams give the same rows as the batch forms, in several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import eventlog
from millrace.session import scratch_path
from millrace.streaming import events as streaming

SCHEMA = (
    "event_id long, ts timestamp, session_id long, event_type string, source string, "
    "level string, message string, duration_ms double, agent string"
)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, start + dt.timedelta(seconds=30 * i), 0 if i % 3 else i % 5, "abc"[i % 3], "s", "info", f"m{i}", float(i), "g")
        for i in range(240)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("events") / "log")
    for part in range(4):
        df.where(f"event_id % 4 = {part}").coalesce(1).write.mode("append").parquet(path)
    return df, path


def stream(spark, log):
    return streaming.read_stream(spark, log[1], log[0].schema, max_files=1)


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_running_counts(spark, log):
    got = streaming.run_to_table(eventlog.running_counts(stream(spark, log)), "complete")
    assert same(got, eventlog.running_counts(log[0]))


def test_newest_per_session(spark, log):
    wide = streaming.newest_candidates(stream(spark, log), keep=7, salts=3, delay="3 hours")
    kept = eventlog.newest_per_session(streaming.run_to_table(wide, "append"), 7)
    want = eventlog.newest_per_session(log[0], 7)
    assert same(kept.select("session_id", "event_id"), want.select("session_id", "event_id"))


def test_sessions_share_groups(spark, log):
    """A batch costs a call for each group, however many sessions there are; null is a session."""
    rows = log[0].withColumn("session_id", F.when(F.col("event_id") % 40 != 0, F.col("event_id") % 60))
    path = scratch_path(spark, "sessions")
    for part in range(3):
        rows.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(path)
    source = streaming.read_stream(spark, path, log[0].schema, max_files=1)
    progress = []
    wide = streaming.newest_candidates(source, keep=2, salts=3, delay="3 hours", groups=5)
    kept = eventlog.newest_per_session(streaming.run_to_table(wide, "append", progress), 2)
    want = eventlog.newest_per_session(rows, 2)
    session = F.coalesce("session_id", F.lit(-1))
    assert same(kept.select(session, "event_id"), want.select(session, "event_id"))
    assert max(p["state_rows"] for p in progress) <= 5


def test_search_on_a_stream(spark, log):
    got = streaming.run_to_table(eventlog.search(stream(spark, log), text="M1").select("event_id"), "append")
    assert same(got, eventlog.search(log[0], text="M1").select("event_id"))


def test_subscribers_do_not_disturb_each_other(spark, log):
    """A failed batch is raised after all were called, and handed out again by the next run."""
    seen, failures = {}, []

    def bad(df, batch):
        if batch == 1 and not failures:
            failures.append(batch)
            raise RuntimeError("broken")

    def good(df, batch):
        seen[batch] = seen.get(batch, []) + [df.count()]

    checkpoint = scratch_path(spark, "pushed")
    with pytest.raises(Exception, match="broken"):
        streaming.push_to(stream(spark, log), [bad, good], checkpoint)
    streaming.push_to(stream(spark, log), [bad, good], checkpoint)
    assert {b: n[-1] for b, n in seen.items()} == {0: 60, 1: 60, 2: 60, 3: 60} and len(seen[1]) == 2


def test_repeats_are_dropped(spark, log):
    twice = stream(spark, log).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    got = streaming.run_to_table(streaming.drop_repeats(twice, "3 hours").select("event_id"), "append")
    assert same(got, log[0].select("event_id"))


def test_a_replay_loses_nothing_whatever_the_order_of_files(spark, log, tmp_path):
    path = str(tmp_path / "late")
    for part in (3, 0, 2, 1):  # the newest hour comes first
        log[0].where(f"event_id div 60 = {part}").coalesce(1).write.mode("append").parquet(path)
    late = streaming.read_stream(spark, path, log[0].schema, max_files=1)
    delay = streaming.replay_delay(log[0])
    got = streaming.run_to_table(streaming.drop_repeats(late, delay).select("event_id"), "append")
    assert same(got, log[0].select("event_id"))
    wide = streaming.newest_candidates(late, keep=7, salts=3, delay=delay)
    kept = eventlog.newest_per_session(streaming.run_to_table(wide, "append"), 7)
    want = eventlog.newest_per_session(log[0], 7)
    assert same(kept.select("session_id", "event_id"), want.select("session_id", "event_id"))


def test_closed_windows_are_final(spark, log):
    got = streaming.run_to_table(streaming.windowed_counts(stream(spark, log), "30 minutes", "3 hours"), "append")
    want = {tuple(r) for r in eventlog.hourly_counts(log[0], "30 minutes").collect()}
    assert {tuple(r) for r in got.collect()} <= want


def test_live_sessions(log):
    last = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=30 * 239)
    out = eventlog.live_sessions(log[0], 600, as_of=last + dt.timedelta(seconds=590))
    assert {r[0] for r in out.select("session_id").distinct().collect()} == {0}
    assert eventlog.live_sessions(log[0], 10**6).count() == log[0].count()


def test_an_ordered_replay_keeps_little_state(spark, tmp_path):
    """20 batches: ids leave the state, the result is exact, nothing is late; ids are texts."""
    start = dt.datetime(2024, 1, 1)
    rows = [(f"id {i:05d}", start + dt.timedelta(seconds=7 * (i * 37 % 4000)), f"s{i % 3}", "a") for i in range(4000)]
    rows += [("no time", None, "s0", "a")]
    events = spark.createDataFrame(rows, "event_id string, ts timestamp, session_id string, event_type string")
    stream, delay = streaming.ordered_replay(events, slices=20, files=2)
    assert int(delay.split()[0]) < 7 * 4000 / 10
    twice = stream.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    progress: list = []
    got = streaming.run_to_table(streaming.drop_repeats(twice, delay).select("event_id"), "append", progress)
    timed = [r for r in rows if r[1] is not None]
    assert {r[0] for r in timed} <= {r[0] for r in got.collect()} and got.count() <= len(rows)
    read = [p for p in progress if p["rows"]]
    assert len(read) >= 20 and max(p["state_rows"] for p in progress) < 1000 and not any(p["late"] for p in progress)
    wide, progress = streaming.newest_candidates(stream, keep=50, salts=4, delay=delay), []
    kept = eventlog.newest_per_session(streaming.run_to_table(wide, "append", progress), 50)
    want = eventlog.newest_per_session(events.where("ts is not null"), 50)
    session = F.coalesce("session_id", F.lit(-1))
    assert same(kept.select(session, "event_id"), want.select(session, "event_id"))
    assert max(p["state_rows"] for p in progress) <= 12


def test_late_rows_are_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "late")
    for hour in (0, 5, 6, 1, 9):  # rows are late for the watermark of the batch before the last
        rows = [(10 * hour + i, start + dt.timedelta(hours=hour, minutes=i)) for i in range(10)]
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    late = streaming.read_stream(spark, path, spark.read.parquet(path).schema, max_files=1)
    progress: list = []
    with pytest.warns(UserWarning, match="10 rows"):
        got = streaming.run_to_table(streaming.drop_repeats(late, "1 hour").select("event_id"), "append", progress)
    assert sum(p["late"] for p in progress) == 10 and got.count() == 40
