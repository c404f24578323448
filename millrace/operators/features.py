"""Derived features: dates, text, products, bins, and F-test selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import exact_quantiles, many_quantiles, numeric_columns, q
from ..session import cut_lineage, kernel_tasks

#: terms whose document frequency is broadcast
FREQUENT_TERMS = 100_000


def date_features(df: DataFrame, column: str) -> DataFrame:
    """year, month, day, weekday (Monday 0), hour, quarter and weekend flag."""
    c = q(column)
    weekday = F.weekday(c)
    return df.withColumns(
        {
            f"{column}_year": F.year(c),
            f"{column}_month": F.month(c),
            f"{column}_day": F.dayofmonth(c),
            f"{column}_weekday": weekday,
            f"{column}_hour": F.hour(c),
            f"{column}_quarter": F.quarter(c),
            f"{column}_is_weekend": (weekday >= 5).cast("int"),
        }
    )


def tokens(column: str):
    """Lower-case runs of word characters."""
    return F.filter(F.split(F.lower(q(column)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def text_counts(df: DataFrame, column: str) -> DataFrame:
    words = tokens(column)
    return df.withColumns(
        {
            f"{column}_chars": F.length(q(column)),
            f"{column}_words": F.size(words),
            f"{column}_unique_words": F.size(F.array_distinct(words)),
        }
    )


def tf_idf(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """(row_id, term, tf, df, tf_idf) with idf = ln((N + 1) / (df + 1)).

    Texts, not their terms, are shuffled to their row id, where a row's terms are
    counted.  The document frequencies of the FREQUENT_TERMS most frequent terms,
    which most rows have, are broadcast; only rows of rarer terms are shuffled
    to theirs.
    """
    total = df.count()
    tf = (
        df.select(q(row_id), q(column))
        .repartition(kernel_tasks(df.sparkSession), q(row_id))
        .select(q(row_id), F.explode(tokens(column)).alias("term"))
        .groupBy(row_id, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    twice = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    if twice.isEmpty():  # a row is a document: its terms are told apart in place
        terms = df.select(F.explode(F.array_distinct(tokens(column))).alias("term"))
    else:
        terms = tf
    seen = cut_lineage(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    top = seen.orderBy(F.col("df").desc(), "term").limit(FREQUENT_TERMS)
    joined = tf.join(F.broadcast(top), "term")
    if seen.count() > FREQUENT_TERMS:
        rare = tf.join(F.broadcast(top), "term", "left_anti").join(seen, "term")
        joined = joined.unionByName(rare)
    return joined.select(
        row_id,
        "term",
        "tf",
        "df",
        (F.col("tf") * F.log(F.lit(total + 1.0) / (F.col("df") + 1.0))).alias("tf_idf"),
    )


def fit_text_vectors(df: DataFrame, column: str, slots: int = 1 << 20, output: str = "text_vector"):
    """MLlib stages (tokenizer, hashed counts, idf) for a text column as model
    input.  Every term counts; none is collected on the driver."""
    from pyspark.ml import Pipeline

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=slots),
            IDF(inputCol="_counts", outputCol=output),
        ]
    ).fit(df)


def polynomial_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of up to `degree` columns, powers included."""
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            product = q(combo[0])
            for c in combo[1:]:
                product = product * q(c)
            new["*".join(combo)] = product
    return df.withColumns(new)


def interaction_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{a}*{b}": q(a) * q(b) for a, b in combinations(columns, 2)})


def bin_equal_width(df: DataFrame, column: str, bins: int = 10, output: str | None = None) -> DataFrame:
    from .distribution import equal_width_bin

    lo, hi = df.agg(F.min(q(column)).cast("double"), F.max(q(column)).cast("double")).first()
    if lo is None or lo == hi:
        return df.withColumn(output or f"{column}_bin", F.when(q(column).isNotNull(), F.lit(0).cast("long")))
    return df.withColumn(output or f"{column}_bin", equal_width_bin(q(column), lo, hi, bins))


def bin_quantile(df: DataFrame, column: str, bins: int = 10, output: str | None = None) -> DataFrame:
    """Bin i holds values in [edge i, edge i+1); equal edges merge."""
    probs = [i / bins for i in range(1, bins)]
    edges = sorted(set(exact_quantiles(df, [column], probs)[column]))
    if edges == [None]:
        return df.withColumn(output or f"{column}_bin", F.lit(None).cast("long"))
    x = q(column).cast("double")
    code = F.lit(0).cast("long")
    for e in edges:
        code = code + F.when(x >= F.lit(e), 1).otherwise(0)
    return df.withColumn(output or f"{column}_bin", F.when(x.isNotNull(), code))


def even_quantiles(df: DataFrame, column: str, levels: int) -> list[float]:
    """Evenly spaced exact quantiles: a few by `exact_quantiles`, many by ranks."""
    if levels <= 50:
        probs = [i / (levels - 1) for i in range(levels)]
        return exact_quantiles(df, [column], probs)[column]
    return many_quantiles(df, column, levels)


def f_scores(df: DataFrame, columns: Sequence[str], target: str, task: str = "classification") -> DataFrame:
    """(column_name, f_score): one-way ANOVA F per feature, or the F of a simple
    regression.  Rows with a missing feature or target are left out per feature."""
    rows = []
    if task == "regression":
        aggs = []
        for i, c in enumerate(columns):
            x, y = q(c).cast("double"), q(target).cast("double")
            aggs += [F.corr(x, y).alias(f"r{i}"), F.count(x + y).alias(f"n{i}")]
        wide = df.agg(*aggs)
        for i, c in enumerate(columns):
            r2 = F.col(f"r{i}") * F.col(f"r{i}")
            rows.append(F.struct(F.lit(c).alias("column_name"), F.try_divide(r2 * (F.col(f"n{i}") - 2), 1 - r2).alias("f_score")))
        return wide.select(F.inline(F.array(*rows)))
    # centre on the column mean first, so the sums of squares do not cancel
    means = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    aggs = []
    for i, c in enumerate(columns):
        x = q(c).cast("double") - F.lit(means[f"m{i}"])
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    groups = df.where(q(target).isNotNull()).groupBy(q(target)).agg(*aggs)
    total = groups.agg(
        *[
            e
            for i in range(len(columns))
            for e in (
                F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}"))).alias(f"b{i}"),
                F.sum(f"s{i}").alias(f"s{i}"),
                F.sum(f"q{i}").alias(f"q{i}"),
                F.sum(f"n{i}").alias(f"n{i}"),
                F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"k{i}"),
            )
        ]
    )
    for i, c in enumerate(columns):
        n, k = F.col(f"n{i}"), F.col(f"k{i}")
        between = F.col(f"b{i}") - F.col(f"s{i}") * F.col(f"s{i}") / n
        within = F.col(f"q{i}") - F.col(f"b{i}")
        f = F.try_divide(F.try_divide(between, k - 1), F.try_divide(within, n - k))
        rows.append(F.struct(F.lit(c).alias("column_name"), f.alias("f_score")))
    return total.select(F.inline(F.array(*rows)))


def select_k_best(df: DataFrame, target: str, k: int, columns: Sequence[str] | None = None, task: str = "classification") -> DataFrame:
    columns = [c for c in (columns if columns is not None else numeric_columns(df)) if c != target]
    scores = {r["column_name"]: r["f_score"] for r in f_scores(df, columns, target, task).collect()}
    best = sorted(columns, key=lambda c: -(scores[c] if scores[c] is not None and not math.isnan(scores[c]) else -1.0))[:k]
    return df.select(*[q(c) for c in df.columns if c in best or c not in columns])
