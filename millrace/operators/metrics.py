"""Classification and regression metrics.

Classification metrics share one table of (label, prediction) counts: a
group-by with map-side combining over the rows, then arithmetic on at most
classes² rows.  Regression metrics are one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import q

EPS = 2.220446049250313e-16


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(q(label).alias("label"), q(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(counts: DataFrame) -> DataFrame:
    """(class, tp, predicted, support) over the union of both label sets."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    truth = counts.select(F.col("label").alias("class"), hit.alias("tp"), F.lit(0).alias("p"), F.col("n").alias("s"))
    guess = counts.select(F.col("prediction").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("p"), F.lit(0).alias("s"))
    return (
        truth.unionByName(guess)
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("p").alias("predicted"), F.sum("s").alias("support"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where undefined."""
    tp, p, s = F.col("tp"), F.col("predicted"), F.col("support")
    return class_counts(counts).select(
        "class",
        _ratio(tp, p).alias("precision"),
        _ratio(tp, s).alias("recall"),
        _ratio(2 * tp, p + s).alias("f1"),
        s.alias("support"),
        "tp",
        "predicted",
    )


def accuracy(counts: DataFrame) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return counts.agg(_ratio(hit, F.sum("n")).alias("accuracy"))


SCORES = ("precision", "recall", "f1")


def averaged_scores(counts: DataFrame, positive=1) -> DataFrame:
    """(average, precision, recall, f1) for weighted, macro, micro and binary."""
    rows = per_class(counts)
    tp, p, s = F.sum("tp"), F.sum("predicted"), F.sum("support")
    is_pos = F.col("class") == F.lit(positive)

    def line(name, columns):
        return rows.agg(*[c.alias(m) for m, c in zip(SCORES, columns)]).select(F.lit(name).alias("average"), *SCORES)

    return reduce(
        DataFrame.unionByName,
        [
            line("weighted", [_ratio(F.sum(F.col(m) * F.col("support")), s) for m in SCORES]),
            line("macro", [F.avg(m) for m in SCORES]),
            line("micro", [_ratio(tp, p), _ratio(tp, s), _ratio(2 * tp, p + s)]),
            line("binary", [F.coalesce(F.max(F.when(is_pos, F.col(m))), F.lit(0.0)) for m in SCORES]),
        ],
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then the summary rows."""
    rows = per_class(counts)
    s = F.sum("support")
    summary = rows.agg(
        _ratio(F.sum("tp"), s).alias("acc"),
        *[F.avg(m).alias(f"m_{m}") for m in SCORES],
        *[_ratio(F.sum(F.col(m) * F.col("support")), s).alias(f"w_{m}") for m in SCORES],
        s.alias("support"),
    )

    def line(name, columns):
        return F.struct(
            F.lit(name).alias("class"), *[F.col(c).alias(m) for m, c in zip(SCORES, columns)], F.col("support")
        )

    extra = summary.select(
        F.inline(
            F.array(
                line("accuracy", ["acc"] * 3),
                line("macro avg", [f"m_{m}" for m in SCORES]),
                line("weighted avg", [f"w_{m}" for m in SCORES]),
            )
        )
    )
    return rows.select(F.col("class").cast("string").alias("class"), *SCORES, "support").unionByName(extra)


def confusion_matrix(counts: DataFrame, labels: Sequence | None = None, normalize: str | None = None) -> DataFrame:
    """(label, prediction, value) for every pair of labels; counts or shares of
    the true row, predicted column or all.  A missing label or prediction is a
    value of its own, as it is a miss for the accuracy; cells add up to all rows."""
    kind = counts.schema["label"].dataType
    if labels is None:
        values = counts.select(F.explode(F.array("label", "prediction")).alias("v")).distinct()
    else:
        values = counts.sparkSession.createDataFrame([(str(v),) for v in labels], "v string").select(F.col("v").cast(kind))
    every = values.agg(F.collect_list(F.struct("v")).alias("vs"))  # one row, an element per class
    grid = every.select("vs", F.explode("vs").alias("a")).select("a", F.explode("vs").alias("b"))
    grid = grid.select(F.col("a.v").alias("label"), F.col("b.v").alias("prediction"))
    had = counts.select(F.col("label").alias("_l"), F.col("prediction").alias("_p"), F.col("n").alias("_n"))
    same = F.col("label").eqNullSafe(F.col("_l")) & F.col("prediction").eqNullSafe(F.col("_p"))
    cells = grid.join(had, same, "left").select("label", "prediction", F.coalesce("_n", F.lit(0)).alias("n"))
    if normalize is None:
        return cells.select("label", "prediction", F.col("n").cast("double").alias("value"))
    key = {"true": ["label"], "pred": ["prediction"], "all": []}[normalize]
    from pyspark.sql.window import Window

    # classes² rows
    return cells.select(
        "label", "prediction", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*key))).alias("value")
    )


def agreement(counts: DataFrame) -> DataFrame:
    """One row: Matthews correlation, Cohen's kappa, balanced accuracy."""
    rows = class_counts(counts)
    c, n = F.sum("tp").cast("double"), F.sum("support").cast("double")
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))
    chance = pt / (n * n)
    seen = F.when(F.col("support") > 0, F.col("tp").cast("double") / F.col("support"))
    return rows.agg(
        F.coalesce(F.try_divide(c * n - pt, F.sqrt((n * n - pp) * (n * n - tt))), F.lit(0.0)).alias("mcc"),
        F.coalesce(F.try_divide(c / n - chance, 1 - chance), F.lit(0.0)).alias("kappa"),
        F.avg(seen).alias("balanced_accuracy"),
    )


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Labels are 0-based positions in the probability array."""
    total = F.aggregate(q(probability), F.lit(0.0), lambda a, x: a + x)
    p = F.get(q(probability), q(label).cast("int")) / total
    inner = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    return df.agg(F.avg(F.when(p.isNotNull(), -F.log(inner))).alias("log_loss"))


# ---- regression ------------------------------------------------------------------


def regression_aggregates(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    y, p = q(label).cast("double"), q(prediction).cast("double")
    known = y.isNotNull() & p.isNotNull()
    y, e = F.when(known, y), y - p
    mse = F.avg(e * e)
    nonzero = F.when(y != 0, F.abs(e / F.when(y != 0, y)))
    return {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(e)),
        "r2": 1.0 - F.try_divide(mse, F.var_pop(y)),
        "explained_variance": 1.0 - F.try_divide(F.var_pop(e), F.var_pop(y)),
        "max_error": F.max(F.abs(e)),
        "mape": F.avg(nonzero) * 100.0,
        "mean_residual": F.avg(e),
        "std_residual": F.stddev_pop(e),
    }


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", n_features: int | None = None
) -> DataFrame:
    """One row; `mape` is NULL when every label is 0, `adjusted_r2` needs the
    number of features and more rows than that plus one."""
    aggs = regression_aggregates(label, prediction)
    out = df.agg(*[c.alias(k) for k, c in aggs.items()], F.count(q(label) - q(prediction)).alias("_n"))
    if n_features is not None:
        n = F.col("_n")
        adjusted = 1.0 - (1.0 - F.col("r2")) * (n - 1) / F.when(n > n_features + 1, n - n_features - 1)
        out = out.withColumn("adjusted_r2", adjusted)
    return out.drop("_n")


def residual_summary(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = q(label).cast("double") - q(prediction).cast("double")
    return df.agg(
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        F.skewness(e).alias("skewness"),
        F.kurtosis(e).alias("kurtosis"),
    )


# ---- one call ---------------------------------------------------------------------


def to_rows(wide: DataFrame) -> DataFrame:
    """One row of metrics → (metric, value)."""
    return wide.select(*[q(c).cast("double").alias(c) for c in wide.columns]).unpivot(
        [], wide.columns, "metric", "value"
    )


def with_interval(rows: DataFrame) -> DataFrame:
    """Add the interval columns; only fold scores (`fold_score_summary`) fill them."""
    none = F.lit(None).cast("double")
    return rows.withColumns({"ci_low": none, "ci_high": none})


def evaluate_classification(
    df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str | None = None
) -> DataFrame:
    """(metric, value, ci_low, ci_high) with weighted averages."""
    from .curves import auc

    counts = confusion_counts(df, label, prediction)
    weighted = averaged_scores(counts).where("average = 'weighted'").select(*SCORES)
    parts = [to_rows(accuracy(counts)), to_rows(weighted), to_rows(agreement(counts))]
    if probability is not None:
        parts.append(to_rows(log_loss(df, label, probability)))
        parts.append(to_rows(auc(df, label, probability)))
    return with_interval(reduce(DataFrame.unionByName, parts))


def evaluate_regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return with_interval(to_rows(regression_metrics(df, label, prediction)))


def format_metrics(rows: DataFrame, digits: int = 4) -> DataFrame:
    text = F.when(F.col("value").isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", "value"))
    return rows.select("metric", text.alias("text"))


def scorer(fn: Callable[[DataFrame], DataFrame], greater_is_better: bool = True) -> Callable[[DataFrame], float]:
    """A user metric: a function from the prediction frame to one value."""

    def score(predictions: DataFrame) -> float:
        value = fn(predictions).first()[0]
        if value is None:
            return math.nan
        return float(value) if greater_is_better else -float(value)

    return score
