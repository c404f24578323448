"""Categorical encoders: fit small tables or lists, transform by projection or join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import dense_codes, q, string_columns
from ..session import cut_lineage
from .profile import column_counts, value_counts

BROADCAST_ROWS = 200_000


@dataclass
class OneHot:
    """Indicator columns `column_value`; the column list is fixed at fit time."""

    categories: dict[str, list[str]]
    keep_source: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        new = [
            F.when(q(c).cast("string") == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}")
            for c, values in self.categories.items()
            for v in values
        ]
        kept = [q(c) for c in df.columns if self.keep_source or c not in self.categories]
        return df.select(*kept, *new)

    def report(self) -> list[tuple]:
        return [(c, "onehot", len(v), len(v)) for c, v in self.categories.items()]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    return {r["column_name"]: r["n_unique"] for r in column_counts(df, columns).collect()}


def fit_onehot(
    df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = 50, drop_first: bool = True
) -> OneHot:
    """Columns with more than `max_categories` values are left alone, so at
    most that many values per column reach the driver."""
    columns = list(columns if columns is not None else string_columns(df))
    sizes = distinct_counts(df, columns)
    narrow = [c for c in columns if sizes.get(c, 0) <= max_categories]
    values: dict[str, list[str]] = {c: [] for c in narrow}
    if narrow:
        for r in value_counts(df, narrow).where("value IS NOT NULL").select("column_name", "value").collect():
            values[r["column_name"]].append(r["value"])
    return OneHot({c: sorted(v)[1 if drop_first else 0 :] for c, v in values.items()})


@dataclass
class CodeTable:
    """(value, code) of one column; unseen values get `unseen`."""

    column: str
    table: DataFrame
    size: int
    missing: str
    unseen: int = -1

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        return _lookup(
            df,
            self.table.select(F.col("value").alias("_value"), F.col("code").alias("_found")),
            F.coalesce(q(self.column).cast("string"), F.lit(self.missing)),
            F.coalesce(F.col("_found"), F.lit(self.unseen)).cast("int"),
            self.size,
            output or self.column,
        )

    def inverse(self, df: DataFrame, coded: str, output: str) -> DataFrame:
        side = self.table.select(F.col("value").alias("_found"), F.col("code").cast("string").alias("_value"))
        return _lookup(df, side, q(coded).cast("string"), F.col("_found"), self.size, output)

    def report(self) -> list[tuple]:
        return [(self.column, "label", self.size, 1)]


def _lookup(df: DataFrame, side: DataFrame, key: Column, value: Column, size: int, output: str) -> DataFrame:
    """Left join with a value table: broadcast only when its size was counted
    to be small, else an equi-join that AQE splits on hot values."""
    side = F.broadcast(side) if size <= BROADCAST_ROWS else side
    names = [q(c) for c in df.columns if c != output]
    placed = df.withColumn("_value", key).join(side, "_value", "left")
    out = value.alias(output)
    if output in df.columns:
        return placed.select(*[out if c == output else q(c) for c in df.columns])
    return placed.select(*names, out)


def fit_labels(df: DataFrame, column: str, missing: str = "unknown") -> CodeTable:
    """Codes 0… in sort order of the values; NULL counts as the text `missing`."""
    values = df.select(F.coalesce(q(column).cast("string"), F.lit(missing)).alias("value")).distinct()
    table = cut_lineage(dense_codes(values, "value"))  # fitted once, not again at each transform
    return CodeTable(column, table, table.count(), missing)


@dataclass
class TargetMeans:
    """Smoothed target mean per value; NULL and unseen values get the prior."""

    column: str
    table: DataFrame
    size: int
    prior: float

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        side = self.table.select(F.col("value").alias("_value"), F.col("mean").alias("_found"))
        return _lookup(
            df,
            side,
            q(self.column).cast("string"),
            F.coalesce(F.col("_found"), F.lit(self.prior)),
            self.size,
            output or self.column,
        )

    def report(self) -> list[tuple]:
        return [(self.column, "target", self.size, 1)]


def fit_target_means(
    df: DataFrame, column: str, target: str, smoothing: float = 1.0, min_samples: int = 20
) -> TargetMeans:
    """prior * (1 - w) + mean * w with w = 1 / (1 + exp(-(n - min_samples) / smoothing))."""
    y = q(target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    weight = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples)) / F.lit(float(smoothing))))
    groups = (
        df.where(q(column).isNotNull())
        .groupBy(q(column).cast("string").alias("value"))
        .agg(F.count(y).alias("n"), F.avg(y).alias("m"))
    )
    table = groups.select("value", (F.lit(prior) * (1.0 - weight) + F.col("m") * weight).alias("mean"))
    table = cut_lineage(table)
    return TargetMeans(column, table, table.count(), prior)


@dataclass
class Binary:
    column: str
    low: str
    high: str

    def transform(self, df: DataFrame) -> DataFrame:
        x = q(self.column).cast("string")
        code = F.when(x == F.lit(self.low), 0).when(x == F.lit(self.high), 1)
        return df.withColumn(self.column, code)

    def report(self) -> list[tuple]:
        return [(self.column, "binary", 2, 1)]


def fit_binary(df: DataFrame, column: str) -> Binary:
    x = q(column).cast("string")
    low, high = df.agg(F.min(x), F.max(x)).first()
    return Binary(column, low, high)


@dataclass
class Frequency:
    """New column `column_frequency` with how often the value occurs; NULL stays NULL."""

    column: str
    table: DataFrame
    size: int

    def transform(self, df: DataFrame) -> DataFrame:
        side = self.table.select(F.col("value").alias("_value"), F.col("n").alias("_found"))
        return _lookup(
            df, side, q(self.column).cast("string"), F.col("_found"), self.size, f"{self.column}_frequency"
        )


def fit_frequency(df: DataFrame, column: str) -> Frequency:
    table = (
        df.where(q(column).isNotNull())
        .groupBy(q(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    table = cut_lineage(table)
    return Frequency(column, table, table.count())


def hash_features(df: DataFrame, columns: Sequence[str], size: int = 32, output: str = "hashed") -> DataFrame:
    """Signed hashing of `column=value` into an array of `size` doubles (MLlib)."""
    hasher = FeatureHasher(inputCols=list(columns), outputCol="_hashed", numFeatures=size)
    return hasher.transform(df).withColumn(output, vector_to_array("_hashed")).drop("_hashed")


def hash_buckets(df: DataFrame, columns: Sequence[str], size: int = 32, prefix: str = "h") -> DataFrame:
    """Signed hashing by md5 of `column=value`, portable between engines:
    digits 1-8 give the bucket, digit 9 the sign; NULL adds nothing."""
    work = df
    for i, c in enumerate(columns):
        h = F.md5(F.concat(F.lit(f"{c}="), q(c).cast("string")))
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(size))
        sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
        work = work.withColumns({f"_b{i}": bucket, f"_s{i}": sign})
    slots = []
    for j in range(size):
        slot = F.lit(0)
        for i in range(len(columns)):
            slot = slot + F.when(F.col(f"_b{i}") == j, F.col(f"_s{i}")).otherwise(0)
        slots.append(slot.alias(f"{prefix}{j}"))
    return work.select(*[q(c) for c in df.columns], *slots)


# ---- choosing ------------------------------------------------------------------


def choose_encoding(n_unique: int, has_target: bool) -> str:
    if n_unique == 2:
        return "binary"
    if n_unique <= 10:
        return "onehot"
    return "target" if n_unique <= 50 and has_target else "label"


@dataclass
class Encoder:
    """Fitted encoders in order, and what was chosen for each column."""

    steps: list
    choices: dict[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def report(self, spark) -> DataFrame:
        rows = [r for s in self.steps for r in s.report()]
        return spark.createDataFrame(rows, "column_name string, method string, categories long, features long")


def fit_encoder(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    strategy: str = "auto",
) -> Encoder:
    """`auto` picks per column by its number of values; otherwise one method for
    all.  Target encoding needs a target and falls back to labels without one."""
    if strategy not in ("auto", "onehot", "label", "target"):
        raise ValueError(f"unknown encoding strategy {strategy}")
    columns = [c for c in (columns if columns is not None else string_columns(df)) if c != target]
    if strategy == "auto":
        sizes = distinct_counts(df, columns)
        choices = {c: choose_encoding(sizes[c], target is not None) for c in columns}
    else:
        method = "label" if strategy == "target" and target is None else strategy
        choices = {c: method for c in columns}
    steps: list = []
    wide = [c for c in columns if choices[c] == "onehot"]
    if wide:
        steps.append(fit_onehot(df, wide))
    for c in columns:
        if choices[c] == "binary":
            steps.append(fit_binary(df, c))
        elif choices[c] == "target":
            steps.append(fit_target_means(df, c, target))
        elif choices[c] == "label":
            steps.append(fit_labels(df, c))
    return Encoder(steps, choices)


def fit_onehot_or_label(df: DataFrame, columns: Sequence[str] | None = None, max_categories: int = 10) -> Encoder:
    """All categories as indicators up to `max_categories`, label codes above."""
    columns = list(columns if columns is not None else string_columns(df))
    sizes = distinct_counts(df, columns)
    narrow = [c for c in columns if sizes[c] <= max_categories]
    steps: list = [fit_onehot(df, narrow, max_categories, drop_first=False)] if narrow else []
    steps += [fit_labels(df, c, missing="nan") for c in columns if c not in narrow]
    return Encoder(steps, {c: "onehot" if c in narrow else "label" for c in columns})
