"""Duplicates, missing cells, outliers and useless columns.

Every fit reads bounded statistics (a few numbers per column) and every
transform is a projection or filter that Catalyst fuses with its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..dist import exact_quantiles, numeric_columns, q, string_columns
from ..session import cached
from .profile import column_counts, iqr_bounds, missing_counts, per_column_outside, value_counts

# ---- duplicates ------------------------------------------------------------


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    order_by: str | None = None,
) -> DataFrame:
    """Keep the first, last or none of equal rows (or of rows equal on `subset`).

    A subset needs `order_by`, the column that says what first means.  All
    forms are group-bys with map-side combining, so a hot group is reduced
    before the shuffle instead of being sorted in one task.
    """
    keys = list(subset) if subset else df.columns
    by = [q(c) for c in keys]
    if keep == "none":
        rest = [c for c in df.columns if c not in keys]
        first = [F.first(q(c)).alias(c) for c in rest]
        return (
            df.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("_n"), *first)
            .where("_n = 1")
            .select(*[q(c) for c in df.columns])
        )
    if not subset:
        return df.dropDuplicates()
    if order_by is None:
        raise ValueError("a subset needs order_by")
    pick = F.min_by if keep == "first" else F.max_by
    whole = F.struct(*[q(c) for c in df.columns])
    # a null order comes last for `first` and first for `last`; the struct itself is never null
    known = F.struct(q(order_by).isNull().alias("null"), q(order_by).alias("value"))
    if keep != "first":
        known = F.struct(q(order_by).isNotNull().alias("known"), q(order_by).alias("value"))
    return df.groupBy(*[q(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(
        pick(whole, known).alias("_row")
    ).select("_row.*")


# ---- missing cells -----------------------------------------------------------


def missing_ratios(df: DataFrame) -> dict[str, float]:
    return {
        r["column_name"]: (r["missing"] / r["rows"] if r["rows"] else 0.0)
        for r in missing_counts(df).collect()  # one row per column
    }


def drop_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns with a larger missing share, then rows with any NULL."""
    ratios = missing_ratios(df)
    kept = [c for c in df.columns if ratios.get(c, 0.0) <= threshold]
    return df.select(*[q(c) for c in kept]).na.drop("any")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value of each column as text; the smallest one on ties."""
    if not columns:
        return {}
    order = Window.partitionBy("column_name").orderBy(
        F.col("n").desc(), F.col("value").try_cast("double"), "value"
    )
    rows = (
        value_counts(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("r", F.row_number().over(order))
        .where("r = 1")
        .collect()
    )
    found = {r["column_name"]: r["value"] for r in rows}
    return {c: found.get(c) for c in columns}


@dataclass
class Imputer:
    """Fill values per column, fitted once and applied to any table."""

    numeric: dict[str, float | None] = field(default_factory=dict)
    text: dict[str, str | None] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if self.numeric.get(c) is not None:
                out.append(F.coalesce(q(c).cast("double"), F.lit(float(self.numeric[c]))).alias(c))
            elif self.text.get(c) is not None:
                out.append(F.coalesce(q(c), F.lit(self.text[c])).alias(c))
            else:
                out.append(q(c))
        return df.select(*out)


def fit_imputer(
    df: DataFrame,
    numeric_strategy: str = "mean",
    text_strategy: str = "most_frequent",
    fill_number: float = 0.0,
    fill_text: str = "missing_value",
    columns: Sequence[str] | None = None,
) -> Imputer:
    chosen = set(columns if columns is not None else df.columns)
    numbers = [c for c in numeric_columns(df) if c in chosen]
    texts = [c for c in string_columns(df) if c in chosen]
    if numeric_strategy == "mean" and numbers:
        row = df.agg(*[F.avg(q(c).cast("double")).alias(c) for c in numbers]).first()
        numeric = {c: row[c] for c in numbers}
    elif numeric_strategy == "median":
        numeric = {c: v[0] for c, v in exact_quantiles(df, numbers, [0.5]).items()}
    elif numeric_strategy == "most_frequent":
        numeric = {c: None if v is None else float(v) for c, v in modes(df, numbers).items()}
    else:
        numeric = {c: fill_number for c in numbers}
    if text_strategy == "most_frequent":
        text = modes(df, texts)
    else:
        text = {c: fill_text for c in texts}
    return Imputer(numeric, text)


@dataclass
class MissingPlan:
    """Columns to drop and values to fill, decided on the fitting table."""

    dropped: list[str]
    imputer: Imputer

    def transform(self, df: DataFrame) -> DataFrame:
        return self.imputer.transform(df.drop(*self.dropped))


def fit_missing(
    df: DataFrame, target: str | None = None, strategy: str = "auto", threshold: float = 0.5
) -> MissingPlan:
    """`aggressive` drops every column that has a NULL; the others drop above
    the threshold and fill the rest with median or mode.  The target is left."""
    if strategy not in ("auto", "conservative", "aggressive"):
        raise ValueError(f"unknown strategy {strategy}")
    ratios = {c: r for c, r in missing_ratios(df).items() if c != target and r > 0}
    limit = 0.0 if strategy == "aggressive" else threshold
    dropped = [c for c, r in ratios.items() if r > limit]
    fill = [c for c in ratios if c not in dropped]
    return MissingPlan(dropped, fit_imputer(df, "median", "most_frequent", columns=fill))


# ---- outliers ----------------------------------------------------------------


@dataclass
class Clipper:
    """Bounds per column; cells outside move to the bound, NULL stays NULL."""

    bounds: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            lo, hi = self.bounds.get(c, (None, None))
            if lo is None:
                out.append(q(c))
                continue
            x = q(c).cast("double")
            out.append(F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x).alias(c))
        return df.select(*out)


def fit_iqr_clip(
    df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5, target: str | None = None
) -> Clipper:
    columns = [c for c in (columns if columns is not None else numeric_columns(df)) if c != target]
    return Clipper(iqr_bounds(df, columns, factor))


def fit_outliers(df: DataFrame, target: str | None = None, strategy: str = "auto") -> Clipper:
    return fit_iqr_clip(df, None, 1.5 if strategy == "aggressive" else 3.0, target)


def fit_winsorizer(
    df: DataFrame, columns: Sequence[str] | None = None, limits: tuple[float, float] = (0.05, 0.95)
) -> Clipper:
    columns = list(columns if columns is not None else numeric_columns(df))
    cuts = exact_quantiles(df, columns, list(limits))
    return Clipper({c: (cuts[c][0], cuts[c][1]) for c in columns})


def remove_outliers(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Drop rows outside the fences, column by column; later bounds see the
    rows that are left.  A column's NULL rows go only when it has outliers."""
    for c in columns if columns is not None else numeric_columns(df):
        lo, hi = iqr_bounds(df, [c], factor)[c]
        if lo is None:
            continue
        inside = (q(c) >= lo) & (q(c) <= hi)
        if not df.where(~inside).isEmpty():
            df = df.where(inside)
    return df


# ---- columns -------------------------------------------------------------------


def drop_constant_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*find_constant_columns(df, target))


def find_constant_columns(df: DataFrame, target: str | None = None) -> list[str]:
    columns = [c for c in df.columns if c != target]
    # min = max decides constancy from one aggregate, without distinct counts
    row = df.agg(
        *[f(q(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.min), ("b", F.max))]
    ).first()
    return [c for i, c in enumerate(columns) if row[f"a{i}"] == row[f"b{i}"]]


def find_high_cardinality(df: DataFrame, target: str | None = None, threshold: float = 0.95) -> list[str]:
    columns = [c for c in string_columns(df) if c != target]
    if not columns:
        return []
    rows = column_counts(df, columns).where(F.col("n_unique") > F.col("rows") * F.lit(threshold)).collect()
    return [r["column_name"] for r in rows]


def drop_high_cardinality_columns(df: DataFrame, target: str | None = None, threshold: float = 0.95) -> DataFrame:
    return df.drop(*find_high_cardinality(df, target, threshold))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.drop(*columns)


def drop_low_variance(df: DataFrame, threshold: float = 0.01, target: str | None = None) -> DataFrame:
    columns = [c for c in numeric_columns(df) if c != target]
    if not columns:
        return df
    row = df.agg(*[F.stddev_samp(q(c).cast("double")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] < threshold])


# ---- the whole cleaner -----------------------------------------------------------


@dataclass
class FittedCleaner:
    missing: MissingPlan
    clipper: Clipper
    constant: list[str]
    wide: list[str]
    report_rows: list[tuple]

    def transform(self, df: DataFrame) -> DataFrame:
        """Same decisions on any table; duplicates are the caller's to drop."""
        return self.clipper.transform(self.missing.transform(df)).drop(*self.constant, *self.wide)

    def report(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            self.report_rows, "step string, column_name string, n long, detail string"
        )


def fit_cleaner(
    df: DataFrame, target: str | None = None, strategy: str = "auto", report: bool = False
) -> FittedCleaner:
    """Decide missing → outliers → constant → high cardinality on `df`, which
    should already be without duplicates.  Several small jobs read it, so it is
    kept while they run."""
    with cached(df) as kept:
        return _fit_cleaner(kept, target, strategy, report)


def _fit_cleaner(df: DataFrame, target: str | None, strategy: str, with_report: bool) -> FittedCleaner:
    counts = {r["column_name"]: r for r in missing_counts(df).collect()}
    missing = fit_missing(df, target, strategy)
    filled = missing.transform(df)
    clipper = fit_outliers(filled, target, strategy)
    clipped = clipper.transform(filled)
    constant = find_constant_columns(clipped, target)
    left = clipped.drop(*constant)
    wide = find_high_cardinality(left, target)
    report = []
    for c in missing.dropped:
        report.append(("missing", c, counts[c]["missing"], "dropped"))
    for c, v in missing.imputer.numeric.items():
        report.append(("missing", c, counts[c]["missing"], "median"))
    for c, v in missing.imputer.text.items():
        report.append(("missing", c, counts[c]["missing"], "mode"))
    fenced = [c for c, b in clipper.bounds.items() if b[0] is not None] if with_report else []
    for r in per_column_outside(filled, fenced, clipper.bounds).where("outliers > 0").collect():
        bounds = f"[{r['lower']:.2f}, {r['upper']:.2f}]"
        report.append(("outliers", r["column_name"], r["outliers"], bounds))
    report += [("constant", c, 1, "dropped") for c in constant]
    report += [("high_cardinality", c, 1, "dropped") for c in wide]
    return FittedCleaner(missing, clipper, constant, wide, report)


def clean(df: DataFrame, target: str | None = None, strategy: str = "auto") -> DataFrame:
    """Duplicates → missing → outliers → constants → high cardinality."""
    unique = drop_duplicates(df)
    return fit_cleaner(unique, target, strategy).transform(unique)


def cleaning_report(df: DataFrame, target: str | None = None, strategy: str = "auto") -> DataFrame:
    """(step, column_name, n, detail) of what `clean` does."""
    unique = drop_duplicates(df)
    fitted = fit_cleaner(unique, target, strategy, report=True)
    repeats = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") - 1).alias("n")
    )
    first = repeats.select(
        F.lit("duplicates").alias("step"),
        F.lit(None).cast("string").alias("column_name"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.lit("removed").alias("detail"),
    )
    return first.unionByName(fitted.report(df))


# ---- names -------------------------------------------------------------------------


def safe_name(c: Column, limit: int = 255) -> Column:
    """Text fit for a file or column name: last path part, specials to '_', the
    extension kept when cut at `limit`."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), r"[^\w\s.-]", "_")
    ext = F.substring_index(base, ".", -1)
    cut = F.concat(F.substring(base, F.lit(1), F.lit(limit - 1) - F.length(ext)), F.lit("."), ext)
    return F.when(F.length(base) <= limit, base).when(base.contains("."), cut).otherwise(F.substring(base, 1, limit))


def rename_safely(df: DataFrame) -> DataFrame:
    import re

    return df.toDF(*[re.sub(r"[^\w\s.-]", "_", c) for c in df.columns])
