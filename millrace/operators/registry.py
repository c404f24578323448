"""Queries over experiment, dataset and session tables.

experiments: id, session_id, status, created_at, completed_at, results
(struct model, metrics map) and params map; sessions: id, user_id; messages:
session_id, created_at, role, content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dist import q, running_totals


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page in a total order, with the number of all rows as `total`."""
    total = df.count()
    return df.orderBy(*order).offset(skip).limit(limit).withColumn("total", F.lit(total).cast("long"))


def list_experiments(
    experiments: DataFrame,
    session_id=None,
    status: str | None = None,
    skip: int = 0,
    limit: int = 100,
) -> DataFrame:
    if session_id is not None:
        experiments = experiments.where(F.col("session_id") == F.lit(session_id))
    if status is not None:
        experiments = experiments.where(F.col("status") == status)
    return page(experiments, [F.col("created_at").desc(), F.col("id")], skip, limit)


def of_user(experiments: DataFrame, sessions: DataFrame, user_id) -> DataFrame:
    """Experiments whose session belongs to the user (a semi join)."""
    mine = sessions.where(F.col("user_id") == F.lit(user_id)).select(F.col("id").alias("session_id"))
    return experiments.join(mine, "session_id", "left_semi")


def with_user(experiments: DataFrame, sessions: DataFrame) -> DataFrame:
    owner = sessions.select(F.col("id").alias("session_id"), "user_id")
    return experiments.join(owner, "session_id")


def experiment_detail(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiments with the metrics and parameters of their run, if it exists."""
    found = runs.select(F.col("run_id"), F.col("metrics").alias("run_metrics"), F.col("params").alias("run_params"))
    return experiments.join(found, experiments["id"] == found["run_id"], "left").drop("run_id")


def _check_ids(experiments: DataFrame, ids: Sequence) -> DataFrame:
    if not 2 <= len(ids) <= 10:
        raise ValueError("compare between 2 and 10 experiments")
    chosen = experiments.where(F.col("id").isin(*ids))
    found = {r["id"] for r in chosen.select("id").distinct().collect()}  # at most 10
    missing = [i for i in ids if i not in found]
    if missing:
        raise LookupError(f"no such experiments: {missing}")
    return chosen


def compare_metrics(experiments: DataFrame, ids: Sequence) -> DataFrame:
    """(id, model, metric, value) of the chosen experiments."""
    chosen = _check_ids(experiments, ids)
    return chosen.select("id", "results.model", F.explode("results.metrics").alias("metric", "value"))


def best_of(experiments: DataFrame, ids: Sequence, metric: str) -> DataFrame:
    """The experiment with the largest metric; the first of `ids` on ties."""
    long = compare_metrics(experiments, ids).where((F.col("metric") == metric) & F.col("value").isNotNull())
    kind = experiments.schema["id"].dataType.simpleString()
    position = F.array_position(F.array(*[F.lit(i).cast(kind) for i in ids]), F.col("id"))
    return long.orderBy(F.col("value").desc(), position).limit(1)


def compare_params(experiments: DataFrame, ids: Sequence) -> DataFrame:
    """One row per parameter (union of keys), one column per experiment."""
    chosen = _check_ids(experiments, ids)
    return (
        chosen.select("id", F.explode("params").alias("param", "value"))
        .groupBy("param")
        .pivot("id", list(ids))
        .agg(F.first("value"))
    )


def accuracy_of(experiments: DataFrame) -> Column:
    return experiments["results"]["metrics"]["accuracy"]


def sort_experiments(experiments: DataFrame, by: str = "recent") -> DataFrame:
    orders = {
        "recent": [F.col("created_at").desc(), F.col("id")],
        "oldest": [F.col("created_at"), F.col("id")],
        "performance": [F.coalesce(accuracy_of(experiments), F.lit(0.0)).desc(), F.col("id")],
    }
    return experiments.orderBy(*orders[by])


def summarize(experiments: DataFrame) -> DataFrame:
    """Totals by status; mean accuracy with missing as 0, and of known nonzero only."""
    done = F.col("status") == "completed"
    acc = accuracy_of(experiments)
    return experiments.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(done, 1)).alias("completed"),
        F.count(F.when(F.col("status") == "running", 1)).alias("running"),
        F.avg(F.when(done, F.coalesce(acc, F.lit(0.0)))).alias("mean_accuracy"),
        F.avg(F.when(acc != 0, acc)).alias("mean_known_accuracy"),
    )


def duration_text(start: Column, end: Column) -> Column:
    """Seconds, minutes or hours (half up) as short text; N/A while running."""
    s = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return (
        F.when(start.isNull() | end.isNull(), "N/A")
        .when(s < 60, F.concat(s.cast("long").cast("string"), F.lit("s")))
        .when(s < 3600, F.concat((s / 60).cast("long").cast("string"), F.lit("m")))
        .otherwise(F.format_string("%.1fh", s / 3600))
    )


def counts_by(experiments: DataFrame) -> DataFrame:
    """(kind, value, n): rows per model and per status from one pass."""
    keyed = experiments.select(F.col("results.model").alias("model"), "status")
    long = keyed.unpivot([], ["model", "status"], "kind", "value")
    return long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def accuracy_trend(experiments: DataFrame) -> DataFrame:
    """Mean accuracy and rows per day and model."""
    rows = experiments.select(
        F.date_format("created_at", "yyyy-MM-dd").alias("day"),
        F.col("results.model").alias("model"),
        accuracy_of(experiments).alias("accuracy"),
    )
    return rows.where("accuracy IS NOT NULL").groupBy("day", "model").agg(
        F.avg("accuracy").alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def file_types(files: DataFrame, name: str) -> DataFrame:
    kind = F.upper(F.element_at(F.split(q(name), r"\."), -1))
    return files.groupBy(kind.alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def list_datasets(datasets: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(datasets, [F.col("created_at").desc(), F.col("id")], skip, limit)


def session_overview(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with message count and last update, most recent first.

    Messages are counted per session before the join, so a busy session
    reaches it as one row.
    """
    counts = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("created_at").alias("updated_at")
    )
    return (
        sessions.join(counts, sessions["id"] == counts["session_id"], "left")
        .select(sessions["id"], F.coalesce("messages", F.lit(0)).alias("messages"), "updated_at")
        .orderBy(F.col("updated_at").desc_nulls_last(), "id")
    )


def session_messages(messages: DataFrame, session_id) -> DataFrame:
    return messages.where(F.col("session_id") == F.lit(session_id)).orderBy("created_at")


def number_messages(messages: DataFrame, tie: str = "id") -> DataFrame:
    """Place of each message in its session, in time order and then by `tie`.

    Messages before a moment come from prefix sums over ranges of time, so a
    session with most of all messages is spread over tasks; a window orders
    only messages of one session and one moment.
    """
    counts = messages.groupBy("session_id", "created_at").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    before = running_totals(counts, "_at", {"_before": "_n"}, partition=["session_id"])
    before = before.select(F.col("session_id").alias("_s"), F.col("created_at").alias("_c"), "_before")
    same = messages["session_id"].eqNullSafe(F.col("_s")) & messages["created_at"].eqNullSafe(F.col("_c"))
    order = Window.partitionBy("session_id", "created_at").orderBy(*([q(tie)] if tie in messages.columns else [F.lit(0)]))
    joined = messages.join(before, same, "left")
    place = F.coalesce("_before", F.lit(0)) + F.row_number().over(order)
    return joined.withColumn("place", place).drop("_s", "_c", "_before")


def cascade_delete(sessions: DataFrame, children: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """All tables without the deleted session ids (column `id`) and their rows."""
    gone = deleted.select(F.col("id").alias("session_id")).distinct()
    out = {"sessions": sessions.join(gone, sessions["id"] == gone["session_id"], "left_anti")}
    for name, child in children.items():
        out[name] = child.join(gone, "session_id", "left_anti")
    return out
