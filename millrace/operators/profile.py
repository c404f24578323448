"""Column profiles and data-quality reports, one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dist import datetime_columns, exact_quantiles, numeric_columns, q, string_columns

Agg = Callable[[Column], Column]


def columns_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, position, type): one row per column, known from the schema."""
    wanted = set(columns if columns is not None else df.columns)
    rows = [(c, i, t) for i, (c, t) in enumerate(df.dtypes) if c in wanted]
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, type string")


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    aggs: dict[str, Agg],
    constants: dict[str, dict[str, float | None]] | None = None,
) -> DataFrame:
    """All aggregates of all columns in one pass, as one row per column.

    `constants` adds fitted values, {name: {column: value}}.
    """
    constants = constants or {}
    if not columns:
        names = ["column_name string"] + [f"{a} double" for a in [*aggs, *constants]]
        return df.sparkSession.createDataFrame([], ", ".join(names))
    wide = df.agg(
        *[fn(q(c)).alias(f"c{i}_{name}") for i, c in enumerate(columns) for name, fn in aggs.items()]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"c{i}_{name}").alias(name) for name in aggs],
            *[F.lit(v[c]).cast("double").alias(name) for name, v in constants.items()],
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n) for every distinct cell, NULL included.

    One shuffle serves distinct counts, missing counts, modes and top-k of all
    columns; equal cells combine before it, so hot values cost nothing.
    """
    columns = list(columns if columns is not None else df.columns)
    cells = df.select(*[q(c).cast("string").alias(c) for c in columns])
    return (
        cells.unpivot([], columns, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, position, type, rows, missing, n_unique)."""
    found = value_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("n_unique"),
    )
    zero = F.lit(0).cast("long")
    # The schema side has one row per column.
    return (
        F.broadcast(columns_table(df, columns))
        .join(found, "column_name", "left")
        .select(
            "column_name",
            "position",
            "type",
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("rows", "missing", "n_unique")],
        )
    )


def percent(part: Column | str, whole: Column | str) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, missing) from one aggregate without a shuffle of cells."""
    columns = list(columns if columns is not None else df.columns)
    return per_column(
        df,
        columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "missing": lambda c: F.count(F.when(c.isNull(), 1)),
        },
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """Row and column counts with the name and type of every column."""
    size = df.agg(F.count(F.lit(1)).alias("n_rows"))
    row = [F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("type")) for c, t in df.dtypes]
    return size.select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.inline(F.array(*row))
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, std (ddof 1), min, quartiles, max, count, missing and distinct count."""
    columns = list(columns if columns is not None else numeric_columns(df))
    cuts = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    moments = per_column(
        df,
        columns,
        {
            "count": F.count,
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
        },
        {name: {c: cuts[c][i] for c in columns} for i, name in enumerate(("q25", "median", "q75"))},
    )
    counts = column_counts(df, columns).select("column_name", "missing", "n_unique")
    return moments.join(F.broadcast(counts), "column_name")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max, without distinct counts."""
    columns = list(columns if columns is not None else numeric_columns(df))
    cuts = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return per_column(
        df,
        columns,
        {
            "count": F.count,
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
        },
        {name: {c: cuts[c][i] for c in columns} for i, name in enumerate(("q25", "median", "q75"))},
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): the k most frequent values of each column."""
    columns = list(columns if columns is not None else string_columns(df))
    order = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value"))
    return (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("column_name", "rank", "value", "n")
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct and missing counts, and the mode, of each string column."""
    columns = list(columns if columns is not None else string_columns(df))
    mode = top_values(df, columns, 1).select(
        "column_name", F.col("value").alias("most_frequent"), F.col("n").alias("most_frequent_count")
    )
    return (
        column_counts(df, columns)
        .select("column_name", "n_unique", "missing")
        .join(F.broadcast(mode), "column_name", "left")
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns that have missing cells, with their share."""
    return (
        missing_counts(df)
        .where(F.col("missing") > 0)
        .select("column_name", "missing", percent("missing", "rows").alias("missing_pct"))
        .orderBy(F.col("missing").desc(), "column_name")
    )


def column_info(df: DataFrame) -> DataFrame:
    return (
        F.broadcast(columns_table(df))
        .join(missing_counts(df), "column_name")
        .select("column_name", "type", "missing", percent("missing", "rows").alias("missing_pct"))
    )


def schema_table(df: DataFrame) -> DataFrame:
    return column_counts(df).select(
        "column_name", "type", (F.col("rows") - F.col("missing")).alias("non_null"), "n_unique"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one (NULL equals NULL) and their share."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    ).select("n_rows", "duplicates", percent("duplicates", "n_rows").alias("duplicate_pct"))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Pairs of equal columns.  A hash sum per column finds the candidates, then
    each candidate pair is compared cell by cell in one aggregate."""
    row_hash = F.xxhash64(*[q(c) for c in df.columns])
    sums = df.select(
        *[
            F.pmod(F.xxhash64(row_hash, q(c).cast("string")), F.lit(1 << 40)).cast("decimal(38,0)").alias(c)
            for c in df.columns
        ]
    ).agg(*[F.sum(q(c)).alias(c) for c in df.columns]).first()
    pairs = [(a, b) for a, b in combinations(df.columns, 2) if sums[a] == sums[b]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string")
    differ = df.agg(
        *[
            F.count(F.when(~q(a).cast("string").eqNullSafe(q(b).cast("string")), 1)).alias(f"d{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    rows = [
        F.struct(
            F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"d{i}").alias("d")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return differ.select(F.inline(F.array(*rows))).where("d = 0").drop("d")


def constant_columns(df: DataFrame, all_null: bool = True) -> DataFrame:
    """Columns with at most one distinct value (`all_null=False`: exactly one)."""
    rule = F.col("n_unique") <= 1 if all_null else F.col("n_unique") == 1
    return column_counts(df).where(rule).select("column_name", "n_unique")


def high_cardinality_columns(df: DataFrame, ratio: float = 0.9) -> DataFrame:
    share = F.try_divide(F.col("n_unique").cast("double"), F.col("rows"))
    return (
        column_counts(df)
        .where((F.col("type") == "string") & (share > ratio))
        .select("column_name", "n_unique", share.alias("ratio"))
    )


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], factor: float = 1.5
) -> dict[str, tuple[float | None, float | None]]:
    cuts = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        lo, hi = cuts[c]
        out[c] = (None, None) if lo is None else (lo - factor * (hi - lo), hi + factor * (hi - lo))
    return out


def outlier_report(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, every: bool = False
) -> DataFrame:
    """Cells outside the IQR fences; columns without any are left out unless `every`."""
    columns = list(columns if columns is not None else numeric_columns(df))
    bounds = iqr_bounds(df, columns, factor)
    rows = per_column_outside(df, columns, bounds)
    if not every:
        rows = rows.where(F.col("outliers") > 0)
    return rows.select(
        "column_name", "outliers", percent("outliers", "rows").alias("outlier_pct"), "lower", "upper"
    )


def per_column_outside(df, columns, bounds) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, rows long, outliers long, lower double, upper double"
        )
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        lo, hi = (F.lit(b).cast("double") for b in bounds[c])
        aggs.append(F.count(F.when((q(c) < lo) | (q(c) > hi), 1)).alias(f"o{i}"))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows"),
            F.col(f"o{i}").alias("outliers"),
            F.lit(bounds[c][0]).cast("double").alias("lower"),
            F.lit(bounds[c][1]).cast("double").alias("upper"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def critical_issues(df: DataFrame, missing_pct: float = 90.0, duplicate_pct: float = 10.0) -> DataFrame:
    empty = missing_report(df).where(F.col("missing_pct") > missing_pct)
    issues = empty.select(
        F.lit("missing").alias("issue"),
        F.format_string("%s: %.1f%% of values missing", "column_name", "missing_pct").alias("detail"),
    )
    repeats = duplicate_rows(df).where(F.col("duplicate_pct") > duplicate_pct)
    return issues.unionByName(
        repeats.select(
            F.lit("duplicates").alias("issue"),
            F.format_string("%.1f%% of rows are duplicates", "duplicate_pct").alias("detail"),
        )
    )


def type_conformance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many cells of each string column do not parse as numbers."""
    columns = list(columns if columns is not None else string_columns(df))
    return per_column(
        df,
        columns,
        {
            "non_null": F.count,
            "not_numeric": lambda c: F.count(
                F.when(c.isNotNull() & c.try_cast("double").isNull(), 1)
            ),
        },
    ).select("column_name", "non_null", "not_numeric", percent("not_numeric", "non_null").alias("not_numeric_pct"))


def pattern_conformance(df: DataFrame, patterns: dict[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, pattern, matches, mismatches) of each string column."""
    columns = list(columns if columns is not None else string_columns(df))
    aggs = []
    rows = []
    for i, c in enumerate(columns):
        for j, (name, regex) in enumerate(patterns.items()):
            hit = q(c).rlike(regex)
            aggs += [F.count(F.when(hit, 1)).alias(f"m{i}_{j}"), F.count(F.when(~hit, 1)).alias(f"x{i}_{j}")]
            rows.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(name).alias("pattern"),
                    F.col(f"m{i}_{j}").alias("matches"),
                    F.col(f"x{i}_{j}").alias("mismatches"),
                )
            )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# The patterns that define a valid e-mail, column name and id.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "column_name": r"^[a-zA-Z0-9_-]+$",
    "uuid": r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
}


def feature_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """Role of each feature and flags for low variance, high cardinality, constant."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in numeric_columns(df) if c != target]
    strings, dates = set(string_columns(df)), set(datetime_columns(df))
    std = per_column(df, numeric, {"std": lambda c: F.stddev_samp(c.cast("double"))})
    role = (
        F.when(F.col("column_name").isin(*numeric), "numeric")
        .when(F.col("column_name").isin(*strings), "categorical")
        .when(F.col("column_name").isin(*dates), "datetime")
        .otherwise("other")
    )
    share = F.try_divide(F.col("n_unique").cast("double"), F.col("rows"))
    return (
        column_counts(df, features)
        .join(F.broadcast(std), "column_name", "left")
        .select(
            "column_name",
            role.alias("role"),
            F.coalesce(F.col("std") < 0.01, F.lit(False)).alias("low_variance"),
            (
                F.col("column_name").isin(*strings)
                & F.coalesce((F.col("n_unique") > 50) | (share > 0.5), F.lit(False))
            ).alias("high_cardinality"),
            (F.col("n_unique") <= 1).alias("constant"),
        )
    )


def varying_scales(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns if columns is not None else numeric_columns(df))
    spans = per_column(df, columns, {"span": lambda c: (F.max(c) - F.min(c)).cast("double")})
    ratio = F.max("span") / (F.min("span") + 1e-10)
    return spans.agg(F.max("span").alias("max_range"), F.min("span").alias("min_range"), ratio.alias("ratio")).select(
        "*", (F.col("ratio") > 1000).alias("varying")
    )


INT_TYPES = [("tinyint", 7), ("smallint", 15), ("int", 31)]


def narrow_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Smallest type that holds each numeric column without loss."""
    columns = list(columns if columns is not None else numeric_columns(df))
    facts = per_column(
        df,
        columns,
        {
            "lo": lambda c: F.min(c.cast("double")),
            "hi": lambda c: F.max(c.cast("double")),
            "whole": lambda c: F.count(F.when(F.floor(c.cast("double")) != c.cast("double"), 1)),
            "wide": lambda c: F.count(F.when(c.cast("float").cast("double") != c.cast("double"), 1)),
        },
    )
    kind = F.when(F.col("lo").isNull(), F.col("type"))
    for name, bits in INT_TYPES:
        kind = kind.when(
            (F.col("whole") == 0) & (F.col("lo") >= -(2**bits)) & (F.col("hi") < 2**bits), name
        )
    kind = (
        kind.when((F.col("whole") == 0) & (F.col("lo") > -(2.0**53)) & (F.col("hi") < 2.0**53), "bigint")
        .when(F.col("wide") == 0, "float")
        .otherwise(F.col("type"))
    )
    return F.broadcast(columns_table(df, columns)).join(facts, "column_name").select(
        "column_name", "type", kind.alias("narrow_type")
    )


def apply_narrow_types(df: DataFrame) -> DataFrame:
    kinds = {r["column_name"]: r["narrow_type"] for r in narrow_types(df).collect()}
    return df.select(*[q(c).cast(kinds[c]).alias(c) if c in kinds else q(c) for c in df.columns])
