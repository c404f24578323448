"""Model comparison, text reports and evaluation bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dist import q
from .curves import class_score_counts, precision_recall_curve, roc_curve
from .metrics import (
    SCORES,
    accuracy,
    averaged_scores,
    classification_report,
    confusion_counts,
    confusion_matrix,
    regression_metrics,
    residual_summary,
    to_rows,
)
from .residuals import prediction_sample, qq_points, residual_histogram, scale_location


def comparison_table(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(model, metric, value) → one row per model, one column per metric."""
    return results.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def rank_models(results: DataFrame, metric: str, minimize: bool = False) -> DataFrame:
    """The best model by one metric; a missing value counts as 0 when
    maximising and as the worst when minimising; ties go to the first name."""
    value = F.when(F.col("metric") == metric, F.col("value"))
    wide = results.groupBy("model").agg(F.max(value).alias("value"))
    if minimize:
        order = [F.col("value").asc_nulls_last(), "model"]
    else:
        order = [F.coalesce("value", F.lit(0.0)).desc(), "model"]
    return wide.orderBy(*order).limit(1)


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.abs("importance").desc(), "feature").limit(n)


def _lines(part: int, df: DataFrame, text, order: Sequence = ()) -> DataFrame:
    """(part, place, line) of a small frame, in its order."""
    place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(0)
    return df.select(F.lit(part).alias("part"), place.alias("place"), text.alias("line"))


def _numbered(df: DataFrame, heads: dict[int, str], parts: list[DataFrame]) -> DataFrame:
    """(position, line): a heading before each part, all in order; a report has some lines for each class and metric."""
    titles = df.sparkSession.createDataFrame([(p, -1, t) for p, t in heads.items()], "part int, place int, line string")
    every = reduce(DataFrame.unionByName, [titles, *parts])
    position = F.row_number().over(Window.orderBy("part", "place")) - 1
    return every.select(position.alias("position"), "line")


def _in_order(names: Sequence[str]):
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))


def classification_lines(
    df: DataFrame, model: str, label: str = "label", prediction: str = "prediction", importance: DataFrame | None = None
) -> DataFrame:
    """(position, line): headline scores, per-class rows, confusion counts and top features."""
    counts = confusion_counts(df, label, prediction)
    weighted = averaged_scores(counts).where("average = 'weighted'").select(*SCORES)
    scores = to_rows(accuracy(counts)).unionByName(to_rows(weighted))
    heads = {0: f"Classification report: {model}", 1: "", 3: "", 4: "class         precision  recall  f1  support", 6: "", 7: "true → predicted: rows"}
    last = F.col("class").try_cast("long")
    parts = [
        _lines(2, scores, F.format_string("%-12s %.4f", "metric", F.round("value", 10)), [_in_order(["accuracy", *SCORES])]),
        _lines(
            5,
            classification_report(counts),
            F.format_string("%-12s %.4f %.4f %.4f %d", "class", *[F.round(x, 10) for x in SCORES], "support"),
            [last.asc_nulls_last(), "class"],
        ),
        _lines(
            8,
            confusion_matrix(counts),
            F.format_string("%s → %s: %.0f", F.col("label").cast("string"), F.col("prediction").cast("string"), "value"),
            ["label", "prediction"],
        ),
    ]
    return _with_importance(df, heads, parts, importance)


def regression_lines(
    df: DataFrame, model: str, label: str = "label", prediction: str = "prediction", importance: DataFrame | None = None
) -> DataFrame:
    """(position, line): metrics, residuals and top features, each in order of their names."""
    text = F.format_string("%-20s %.4f", "metric", F.round("value", 10))
    heads = {0: f"Regression report: {model}", 1: "", 3: "", 4: "Residuals"}
    parts = [
        _lines(2, to_rows(regression_metrics(df, label, prediction)), text, ["metric"]),
        _lines(5, to_rows(residual_summary(df, label, prediction)), text, ["metric"]),
    ]
    return _with_importance(df, heads, parts, importance)


def _with_importance(df, heads: dict[int, str], parts: list[DataFrame], importance: DataFrame | None) -> DataFrame:
    if importance is not None:
        heads = {**heads, 90: "", 91: "Top features"}
        text = F.format_string("%-20s %.4f", "feature", "importance")
        parts = [*parts, _lines(92, top_importance(importance, 10), text, [F.abs("importance").desc(), "feature"])]
    return _numbered(df, heads, parts)


def _text(lines: DataFrame) -> str:
    return "\n".join(r["line"] for r in lines.orderBy("position").collect())


def classification_text(df: DataFrame, model: str, label: str = "label", prediction: str = "prediction", importance: DataFrame | None = None) -> str:
    """The lines of a report in one text."""
    return _text(classification_lines(df, model, label, prediction, importance))


def regression_text(df: DataFrame, model: str, label: str = "label", prediction: str = "prediction", importance: DataFrame | None = None) -> str:
    return _text(regression_lines(df, model, label, prediction, importance))


#: columns that name a row of a section
SECTION_KEYS = {
    "confusion": ["label", "prediction"], "report": ["class"], "roc": ["class"], "precision_recall": ["class"],
    "metrics": ["metric"], "residuals": ["metric"], "residual_histogram": ["bin"], "qq": ["position"],
}


def bundle_rows(parts: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(section, key, name, value): all frames of a bundle as one table; the rest of a frame's columns are values."""
    out = []
    for section, df in parts.items():
        own = {**SECTION_KEYS, **keys}[section]
        values = [c for c in df.columns if c not in own]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), q(c).cast("double").alias("value")) for c in values])
        key = F.concat_ws("/", *[q(c).cast("string") for c in own])
        out.append(df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(cells)))
    return reduce(DataFrame.unionByName, out)


def evaluation_bundle(
    df: DataFrame, task: str, key: str, label: str = "label", prediction: str = "prediction", probability: str | None = None
) -> dict[str, DataFrame]:
    """The frames behind an evaluation report, by problem type."""
    if task == "classification":
        counts = confusion_counts(df, label, prediction)
        out = {"confusion": confusion_matrix(counts), "report": classification_report(counts)}
        if probability is not None:
            points = class_score_counts(df, label, probability)
            out["roc"] = roc_curve(points)
            out["precision_recall"] = precision_recall_curve(points)
        return out
    return {
        "metrics": to_rows(regression_metrics(df, label, prediction)),
        "residuals": to_rows(residual_summary(df, label, prediction)),
        "residual_histogram": residual_histogram(df, label, prediction),
        "qq": qq_points(df, label, prediction),
        "scale_location": scale_location(df, label, prediction).select(q(key), q(prediction), "sqrt_abs_standardized"),
        "sample": prediction_sample(df, key, label=label, prediction=prediction),
    }


def learning_curve_summary(scores: DataFrame) -> DataFrame:
    """(size, fold, train_score, valid_score) → mean and population std per size."""
    return scores.groupBy("size").agg(
        F.avg("train_score").alias("train_mean"),
        F.stddev_pop("train_score").alias("train_std"),
        F.avg("valid_score").alias("valid_mean"),
        F.stddev_pop("valid_score").alias("valid_std"),
    )
