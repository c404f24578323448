"""Threshold curves and areas from exact cumulative counts over scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import BUCKET_ROWS, q, running_totals


def score_counts(
    df: DataFrame, label: str, score: str, positive=1, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(class, threshold, pos, neg, tp, fp): counts at and above each distinct
    score.  Equal scores combine before anything is ordered."""
    pos = F.when(q(label) == F.lit(positive), 1).otherwise(0)
    rows = df.select(F.lit(positive).cast("string").alias("class"), q(score).cast("double").alias("threshold"), pos.alias("y"))
    return _cumulate(rows, bucket_rows)


def class_score_counts(df: DataFrame, label: str, probability: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The same for each class against the rest, from a probability array."""
    rows = df.select(q(label).cast("int").alias("_y"), F.posexplode(q(probability)).alias("k", "threshold"))
    pos = F.when(F.col("_y") == F.col("k"), 1).otherwise(0)
    return _cumulate(rows.select(F.col("k").cast("string").alias("class"), "threshold", pos.alias("y")), bucket_rows)


def _cumulate(rows: DataFrame, bucket_rows: int) -> DataFrame:
    counts = (
        rows.where(F.col("threshold").isNotNull())
        .groupBy("class", "threshold")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        .withColumn("_down", -F.col("threshold"))
    )
    run = running_totals(counts, "_down", {"_tp": "pos", "_fp": "neg"}, ["class"], bucket_rows)
    return run.select(
        "class",
        "threshold",
        "pos",
        "neg",
        (F.col("_tp") + F.col("pos")).alias("tp"),
        (F.col("_fp") + F.col("neg")).alias("fp"),
    )


def _totals(points: DataFrame) -> DataFrame:
    return points.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def roc_curve(points: DataFrame) -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, from the origin on."""
    totals = F.broadcast(_totals(points))  # one row per class
    curve = points.join(totals, "class").select(
        "class",
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )
    origin = totals.select("class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return curve.unionByName(origin)


def precision_recall_curve(points: DataFrame) -> DataFrame:
    """(class, threshold, precision, recall) plus the closing point (1, 0)."""
    totals = F.broadcast(_totals(points))
    tp = F.col("tp").cast("double")
    curve = points.join(totals, "class").select(
        "class",
        "threshold",
        (tp / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("P")), F.lit(1.0)).alias("recall"),
    )
    end = totals.select("class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def precision_summary(points: DataFrame) -> DataFrame:
    """Per class: average precision, and the plain mean of curve precisions."""
    precision = F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))
    return points.groupBy("class").agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("average_precision"),
        ((F.sum(precision) + 1.0) / (F.count(F.lit(1)) + 1)).alias("mean_precision"),
    )


def class_auc(points: DataFrame) -> DataFrame:
    """(class, auc, support): each negative ranks against the positives above it,
    ties counting half; NULL with one class only."""
    above = F.col("tp") - F.col("pos") + F.col("pos") / 2.0
    return points.groupBy("class").agg(
        F.try_divide(F.sum(F.col("neg") * above), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        F.sum("pos").alias("support"),
    )


def auc(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """One row `roc_auc`: the positive class for two classes, else one-vs-rest
    areas weighted by support."""
    areas = class_auc(class_score_counts(df, label, probability))
    two = F.count(F.lit(1)) == 2
    binary = F.max(F.when(F.col("class") == "1", F.col("auc")))
    weighted = F.sum(F.col("auc") * F.col("support")) / F.sum("support")
    return areas.agg(F.when(two, binary).otherwise(weighted).alias("roc_auc"))
