"""Target detection, analysis and validation, and preprocessing advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import numeric_columns, q
from ..functions.moments import kurtosis_g2_unbiased, skewness_g1_unbiased
from .profile import (
    column_counts,
    duplicate_rows,
    feature_roles,
    missing_report,
    outlier_report,
    varying_scales,
)


def _is_label(df: DataFrame, target: str) -> bool:
    return isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return (
        df.where(q(target).isNotNull())
        .groupBy(q(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _class_facts(df: DataFrame, target: str) -> DataFrame:
    """One row of counts over the distinct target values, NULL among them."""
    groups = df.groupBy(q(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), zero).alias("missing"),
        F.count("v").alias("n_unique"),
        F.max(known).alias("largest"),
        F.min(known).alias("smallest"),
    )


def analyze_target(df: DataFrame, target: str) -> DataFrame:
    """One row: problem type, class balance, or moments of a numeric target."""
    facts = _class_facts(df, target)
    if _is_label(df, target):
        ratio = F.try_divide(F.col("largest").cast("double"), F.col("smallest"))
        return facts.select(
            F.lit(target).alias("target"),
            F.lit("classification").alias("problem_type"),
            "n_unique",
            "missing",
            ratio.alias("imbalance_ratio"),
            (ratio > 10).alias("imbalanced"),
        )
    x = q(target).cast("double")
    moments = df.agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        skewness_g1_unbiased(x).alias("skewness"),
        kurtosis_g2_unbiased(x).alias("kurtosis"),
    ).first()
    share = F.try_divide(F.col("n_unique").cast("double"), F.col("rows"))
    return facts.select(
        F.lit(target).alias("target"),
        F.when((share < 0.05) & (F.col("n_unique") < 20), "classification")
        .otherwise("regression")
        .alias("problem_type"),
        "n_unique",
        "missing",
        *[F.lit(v).cast("double").alias(k) for k, v in moments.asDict().items()],
    )


# Name parts that hint at a target column.
TARGET_KEYWORDS = ["target", "label", "class", "y", "outcome", "result"]


def target_candidates(df: DataFrame, top: int = 5) -> DataFrame:
    """Columns that look like a target, best first."""
    numeric = numeric_columns(df)
    n = F.col("n_unique")
    share = F.try_divide(n.cast("double"), F.col("rows"))
    hint = F.lit(False)
    for word in TARGET_KEYWORDS:
        hint = hint | F.lower("column_name").contains(word)
    score = (
        F.when(hint, 30).otherwise(0)
        + F.when(F.col("position") == len(df.columns) - 1, 10).otherwise(0)
        + F.when(n == 2, 20)
        .when((n > 2) & (n <= 20) & (F.col("type") == "string"), 15)
        .when(F.col("column_name").isin(*numeric) & (share > 0.1) & (share < 0.9), 10)
        .otherwise(0)
    )
    return (
        column_counts(df)
        .withColumn("score", score)
        .where(F.col("score") > 0)
        .orderBy(F.col("score").desc(), "position")
        .limit(top)
        .select("column_name", "score", "type", "n_unique", "missing")
    )


def validate_target(df: DataFrame, target: str, problem_type: str) -> DataFrame:
    """(ok, message); the first rule that fails decides the message."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.createDataFrame(
            [(False, f"no column {target}")], "ok boolean, message string"
        )
    n = F.col("n_unique")
    message = F.when(
        F.col("missing") > 0,
        F.concat(F.col("missing").cast("string"), F.lit(" rows lack the target")),
    )
    if problem_type == "classification":
        message = (
            message.when(n < 2, "a single class")
            .when(
                n > 100,
                F.concat(
                    n.cast("string"), F.lit(" classes are too many; treat the target as a number")
                ),
            )
            .when(
                F.col("smallest") < 5,
                F.concat(
                    F.lit("a class of "),
                    F.col("smallest").cast("string"),
                    F.lit(" rows; 5 are needed"),
                ),
            )
        )
    elif target not in numeric_columns(df):
        message = message.otherwise(F.lit("target is no number"))
    else:
        # one distinct value over at least two rows is a zero deviation
        message = message.when((n == 1) & (F.col("rows") > 1), "target never varies")
    return _class_facts(df, target).select(message.isNull().alias("ok"), message.alias("message"))


def recommend_cleaning(df: DataFrame, target: str | None = None) -> DataFrame:
    """Advice by rule, most urgent first: (priority, rule, action, column_name, strategy, reason)."""
    numeric = numeric_columns(df)

    def advice(rows, rule, priority, action, column, strategy, reason):
        return rows.select(
            F.lit(priority).alias("priority"),
            F.lit(rule).alias("rule"),
            F.lit(action).alias("action"),
            column.alias("column_name"),
            strategy.cast("string").alias("strategy"),
            reason.alias("reason"),
        )

    name, none = F.col("column_name"), F.lit(None)
    missing = missing_report(df)
    pct = F.col("missing_pct")
    roles = feature_roles(df, target)
    parts = [
        advice(
            missing.where(pct > 50), 1, "high", "drop_column", name, none,
            F.format_string("%.1f%% of the cells are missing, too many to fill", pct),
        ),
        advice(
            missing.where(pct <= 50), 2, "medium", "impute", name,
            F.when(name.isin(*[c for c in numeric if c != target]), "mean").otherwise("mode"),
            F.format_string("%.1f%% of the cells are missing", pct),
        ),
        advice(
            outlier_report(df, numeric).where(F.col("outlier_pct") > 5), 3, "medium",
            "handle_outliers", name, F.lit("clip"),
            F.format_string("%.1f%% of the values are outliers", F.col("outlier_pct")),
        ),
        advice(
            roles.where("high_cardinality"), 4, "high", "encode_categorical", name,
            F.lit("target_encoding"), F.lit("many distinct texts"),
        ),
        advice(
            varying_scales(df, [c for c in numeric if c != target]).where("varying"), 5, "high",
            "scale_features", F.lit(None).cast("string"), F.lit("standard"),
            F.lit("ranges differ a thousandfold"),
        ),
        advice(
            roles.where("constant"), 6, "high", "drop_column", name, none,
            F.lit("a single value"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    urgency = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return out.orderBy(urgency, "rule", "column_name")


def recommend_overall(df: DataFrame, task: str = "classification") -> DataFrame:
    """(section, item, value): whole-table advice on cleaning, encoding and scaling."""
    counts = column_counts(df)
    outliers = outlier_report(df, every=True).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("n"))
    some = F.col("n") > 0

    def items(rows, *triples):
        return rows.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(section).alias("section"),
                            F.lit(name).alias("item"),
                            value.cast("string").alias("value"),
                        )
                        for section, name, value in triples
                    ]
                )
            )
        )

    method = "isolation_forest" if task == "regression" else "iqr"
    wide = counts.where((F.col("type") == "string") & (F.col("n_unique") > 10))
    return (
        items(
            outliers,
            ("cleaning", "outliers_needed", some),
            ("cleaning", "outlier_method", F.lit(method)),
            ("scaling", "strategy", F.when(some, "robust").otherwise("standard")),
        )
        .unionByName(
            items(
                duplicate_rows(df),
                ("cleaning", "duplicates_needed", F.col("duplicates") > 0),
                ("cleaning", "duplicate_count", F.col("duplicates")),
            )
        )
        .unionByName(
            items(counts.agg(F.sum("missing").alias("m")), ("cleaning", "total_missing", F.col("m")))
        )
        .unionByName(items(wide, ("encoding", "high_cardinality", F.col("column_name"))))
    )
