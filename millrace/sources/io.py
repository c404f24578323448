"""Readers, writers and admission of table files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import hash_key, nan_to_null, q
from ..operators.profile import missing_counts
from ..session import cut_lineage
from . import ranges

FORMATS = ("csv", "json", "parquet")
MAX_BYTES = 500 * 1024 * 1024
ALLOWED = ("csv", "json", "parquet", "xlsx", "xls")


#: fixed values: quotes are doubled inside quoted fields; NULL is an empty field, an empty string is quoted
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": None}
WRITE_OPTIONS = {"quote": '"', "escape": '"', "emptyValue": '""', "nullValue": ""}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    max_rows: int | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """Header row, types from `schema` or inferred; `max_rows` becomes a limit
    that Spark takes from the first files, and types come from those rows alone.

    Quotes inside a field are doubled and fields may hold line breaks, as most
    tools write them.  Files are split all the same: a scan of the quotes tells
    where records begin in each range.  `line_breaks=False` promises that no
    field holds one and saves that scan.  Records end with a line feed, with or
    without a carriage return before it.  An empty field is NULL and a quoted
    empty one the empty string.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=line_breaks)
    if max_rows is not None:
        schema = schema or infer_types(reader.csv(path).limit(max_rows))
        return reader.schema(schema).csv(path).limit(max_rows)
    if not line_breaks:
        return reader.schema(schema or infer_types(reader.csv(path))).csv(path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(path).columns])
    rows = ranges.lines(spark, path)
    records = ranges.records(rows, cut_lineage(ranges.quote_states(rows)))

    def parsed(kind: T.StructType) -> DataFrame:
        ddl = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in kind)
        options = {k: str(v) for k, v in CSV_OPTIONS.items() if v is not None and k != "header"}
        return records.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")

    if schema is None:
        schema = infer_types(parsed(text))
    return parsed(spark.createDataFrame([], schema).schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def infer_types(head: DataFrame) -> T.StructType:
    """Schema of text columns: the first type that takes every value of a column."""
    kinds = ["int", "bigint", "double", "date", "timestamp", "boolean"]

    def fits(c: str, kind: str):
        ok = q(c).try_cast(kind).isNotNull()
        if kind == "date":
            ok = ok & q(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        return F.coalesce(F.bool_and(F.when(q(c).isNotNull(), ok)), F.lit(False))

    row = head.agg(*[fits(c, k).alias(f"{k}{i}") for i, c in enumerate(head.columns) for k in kinds]).first()
    found = [next((k for k in kinds if row[f"{k}{i}"]), "string") for i in range(len(head.columns))]
    return T.StructType([T.StructField(c, T.DataType.fromDDL(k)) for c, k in zip(head.columns, found)])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """One array of records per file, or one record per line (splittable)."""
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema is not None else reader.json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Through Hadoop, so any file system the cluster knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_dataset(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet if present, else CSV."""
    for kind, read in (("parquet", spark.read.parquet), ("csv", lambda p: read_csv(spark, p))):
        path = f"{base}/{name}.{kind}"
        if exists(spark, path):
            return nan_to_null(read(path))
    raise FileNotFoundError(f"{base}/{name}.parquet or .csv")


def read_dataset(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return nan_to_null(read_csv(spark, path, schema))
    if kind == "json":
        return nan_to_null(read_json(spark, path, schema))
    if kind == "parquet":
        return nan_to_null(spark.read.parquet(path))
    raise ValueError(f"unsupported file type .{kind}")


def preview(df: DataFrame, rows: int = 10, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first rows; with a key they are the same ones every time."""
    ordered = df.orderBy(*[q(c) for c in order_by]) if order_by else df
    return ordered.limit(rows)


def sample_rows(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(key, seed)).limit(rows)


def write_dataset(df: DataFrame, path: str, kind: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parallel write of one folder in the wanted format."""
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.options(header=True, escapeQuotes=True, **WRITE_OPTIONS).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def list_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name, extension, bytes[, content]) of the files below a path.
    Spark prunes `content`, so a listing does not read the files."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extra = ["content"] if content else []
    return files.select(
        "path",
        name.alias("name"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"),
        F.col("length").alias("bytes"),
        *extra,
    )


def admit_files(files: DataFrame, allowed: Sequence[str] = ALLOWED, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add `reason` (NULL when admitted): wrong type, or too large."""
    reason = F.when(~F.col("extension").isin(*allowed), "file type").when(F.col("bytes") > max_bytes, "file size")
    return files.withColumn("reason", reason)


def new_files(spark: SparkSession, path: str, known: DataFrame, block_bytes: int = 1 << 22) -> DataFrame:
    """(path, hash) of files whose content hash (`ranges.file_digests`) is not in
    `known`; of equal files below the path one is kept."""
    hashed = ranges.file_digests(spark, path, block_bytes).select("path", "hash")
    once = hashed.groupBy("hash").agg(F.min("path").alias("path"))
    return once.join(known.select("hash"), "hash", "left_anti")


def validate_format(df: DataFrame, min_rows: int = 10, first_rows: int | None = None) -> DataFrame:
    """(ok, message): not empty, two columns, ten rows, no column all missing.
    `first_rows` limits the look to the head of the table."""
    if first_rows is not None:
        df = df.limit(first_rows)
    facts = missing_counts(df) if df.columns else None
    if facts is None:
        return df.sparkSession.createDataFrame([(False, "no rows")], "ok boolean, message string")
    empty = F.array_sort(F.collect_list(F.when(F.col("missing") == F.col("rows"), F.col("column_name"))))
    one = facts.agg(F.max("rows").alias("rows"), empty.alias("empty"))  # one row per column goes in
    message = (
        F.when(F.col("rows") == 0, "no rows")
        .when(F.lit(len(df.columns) < 2), "fewer than 2 columns")
        .when(F.col("rows") < min_rows, f"fewer than {min_rows} rows")
        .when(F.size("empty") > 0, F.concat(F.lit("only missing values in: "), F.array_join("empty", ", ")))
    )
    return one.select(message.isNull().alias("ok"), message.alias("message"))
