"""Source and sink queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ...dist import nan_to_null
from ...operators import tune
from ...operators.clean import drop_duplicates
from ...session import scratch_path
from ...sources import io, ranges, store
from ..preprocess import fit_preprocessor
from .base import DIRTY_SQL, dirty_orders, query, rounded, table
from .scaling import Z20_SQL

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NAME = "element_at(split(path, '/'), -1)"


@query("s1_read_csv", CUSTOMER)
def s1(spark, d):
    path = scratch_path(spark, "customer") + ".csv"
    df = table(spark, d, "customer")
    io.write_dataset(df, path, "csv")
    return io.read_csv(spark, path, df.schema)


@query("s1_read_csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s1c(spark, d):
    """Quotes and line breaks in fields come back as they were."""
    path = scratch_path(spark, "documents") + ".csv"
    df = table(spark, d, "documents")
    io.write_dataset(df, path, "csv")
    return io.read_csv(spark, path, df.schema)


@query("s1_read_csv_inferred", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def s1b(spark, d):
    path = scratch_path(spark, "orders") + ".csv"
    io.write_dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, "csv")
    return io.read_dataset(spark, path)


@query("s2_read_json", CUSTOMER)
def s2(spark, d):
    path = scratch_path(spark, "customer") + ".json"
    df = table(spark, d, "customer")
    io.write_dataset(df, path, "json")
    return io.read_json(spark, path, df.schema, lines=True)


@query("s2_read_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s2b(spark, d):
    df = table(spark, d, "nation")
    path = scratch_path(spark, "nation") + ".json"
    # a file for each region, holding one array
    rows = df.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.write.partitionBy("n_regionkey").text(path)
    return io.read_json(spark, f"{path}/n_regionkey=*", df.schema)


@query("s3_load_dataset", "SELECT * FROM part")
def s3(spark, d):
    return io.load_dataset(spark, d, "part")


@query("s4_preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def s4(spark, d):
    return io.preview(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10, ["o_orderkey"])


@query("s5_sample_download", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey) LIMIT 1000")
def s5(spark, d):
    df = io.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000)
    path = scratch_path(spark, "sample") + ".csv"
    io.write_dataset(df, path, "csv")
    return io.read_csv(spark, path, df.schema)


@query("s6_write_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def s6(spark, d):
    path = scratch_path(spark, "orders") + ".parquet"
    io.write_dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "parquet", ["o_orderstatus"])
    return io.read_dataset(spark, path)


TEXTS = """texts AS (SELECT o_orderpriority AS name, string_agg(o_orderkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1)"""
BLOCK = 4096
DIGEST = f"""CASE WHEN length(t) <= {BLOCK} THEN md5(t) ELSE md5(array_to_string(
 list_transform(range(0, length(t), {BLOCK}), lambda i: md5(substr(t, CAST(i + 1 AS BIGINT), {BLOCK}))), '')) END"""


def order_files(spark, d):
    """A folder for each priority with one text file, and the name of a file's folder."""
    path = scratch_path(spark, "orders")
    rows = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("name"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"), "o_orderkey"
    )
    rows = rows.repartition("name").sortWithinPartitions("name", "o_orderkey").drop("o_orderkey")
    rows.write.partitionBy("name").text(path)
    return f"{path}/name=*/*.txt", F.regexp_extract("path", "name=([^/]+)/", 1).alias("name")


@query("s7_admit_files", f"WITH {TEXTS} SELECT name, length(t) AS bytes, CASE WHEN length(t) > 30000 THEN 'file size' END AS reason FROM texts")
def s7(spark, d):
    path, name = order_files(spark, d)
    return io.admit_files(io.list_files(spark, path), allowed=["txt"], max_bytes=30_000).select(name, "bytes", "reason")


@query("s8_new_files", f"WITH {TEXTS} SELECT name, {DIGEST} AS hash FROM texts WHERE name <> '5-LOW'")
def s8(spark, d):
    """Files are hashed in blocks; one of them is known."""
    path, name = order_files(spark, d)
    known = ranges.file_digests(spark, path.replace("name=*", "name=5-LOW"), BLOCK)
    return io.new_files(spark, path, known, BLOCK).select(name, "hash")


@query("s9_validate_format", f"""WITH {DIRTY_SQL} SELECT 'dirty' AS name, true AS ok, CAST(NULL AS VARCHAR) AS message FROM dirty HAVING count(*) >= 10 AND count(mostly_null) > 0
UNION ALL SELECT 'hollow', false, 'only missing values in: hollow' FROM orders HAVING count(*) >= 10
UNION ALL SELECT 'region', false, 'fewer than 10 rows' FROM region HAVING count(*) < 10
UNION ALL SELECT 'narrow', false, 'fewer than 2 columns' FROM orders HAVING count(*) > 0""")
def s9(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    frames = {
        "dirty": dirty_orders(spark, d),
        "hollow": orders.withColumn("hollow", F.lit(None).cast("string")),
        "region": table(spark, d, "region"),
        "narrow": orders,
    }
    out = None
    for name, df in frames.items():
        row = io.validate_format(df).select(F.lit(name).alias("name"), "ok", "message")
        out = row if out is None else out.unionByName(row)
    return out


@query("s10_register_dataset", f"""WITH {DIRTY_SQL} SELECT 'd1' AS id, count(*) AS rows_count, CAST(7 AS INTEGER) AS columns_count,
CAST(count(*) - count(o_totalprice) AS VARCHAR) AS missing_price, 'double' AS price_type FROM dirty""")
def s10(spark, d):
    path = scratch_path(spark, "datasets")
    store.append(store.dataset_row(dirty_orders(spark, d), "d1", "u1", "orders.csv", "/data/orders.csv", 0), path)
    meta = F.col("metadata")
    return spark.read.parquet(path).select(
        "id", "rows_count", "columns_count", meta["missing.o_totalprice"].alias("missing_price"), meta["type.o_totalprice"].alias("price_type"))


@query("s11_reload_model", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code, round(o_totalprice, 6) AS price FROM orders")
def s11(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    stages = [
        StringIndexer(inputCol="o_orderpriority", outputCol="code", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=["code", "o_totalprice"], outputCol="features"),
    ]
    path = scratch_path(spark, "model")
    store.save_model(Pipeline(stages=stages).fit(df), path)
    v = vector_to_array("features")
    out = store.load_model(path).transform(df)
    return rounded(out.select("o_orderkey", v[0].alias("code"), v[1].alias("price")))


@query("s11_reload_preprocessor", Z20_SQL)
def s11b(spark, d):
    df = dirty_orders(spark, d)
    fitted = fit_preprocessor(df, target="o_totalprice", preset="standard", keep=["o_orderkey"])
    path = scratch_path(spark, "preprocessor")
    store.save_fitted(spark, fitted, path)
    return rounded(store.load_fitted(spark, path).transform(drop_duplicates(nan_to_null(df))))


@query("s12_continue_study", "SELECT * FROM (VALUES (0, 'COMPLETE'), (1, 'COMPLETE'), (2, 'COMPLETE'), (3, 'COMPLETE')) AS t(trial, state) WHERE (SELECT count(*) FROM orders) > 0")
def s12b(spark, d):
    """Two trials, saved and loaded, and two more: the same points as four at once."""
    orders = table(spark, d, "orders")
    space = {"share": tune.Param("float", 0.1, 0.9)}

    def objective(params):
        return orders.agg(F.percentile_approx("o_totalprice", params["share"])).first()[0]

    path = scratch_path(spark, "study")
    store.save_fitted(spark, tune.Study(space).run(objective, 2), path)
    study = store.load_fitted(spark, path).run(objective, 2)
    whole = tune.Study(space).run(objective, 4)
    if study.points != whole.points:
        raise AssertionError("a continued study must draw the points of an unbroken one")
    return study.frame(spark).select("trial", "state")


@query("s12_reload_study", "SELECT p_partkey AS trial, p_retailprice AS value FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def s12(spark, d):
    from ...operators.trials import best_trial

    trials = table(spark, d, "part").select(
        F.col("p_partkey").alias("trial"), F.col("p_retailprice").alias("value"), F.lit("COMPLETE").alias("state"))
    path = scratch_path(spark, "study")
    store.save_study(trials, path)
    return best_trial(store.load_study(spark, path), "maximize").select("trial", "value")


@query("s13_append_experiment", "SELECT 'e1' AS id, 'completed' AS status, 'rule' AS model, round(avg(o_totalprice), 4) AS mean_price FROM orders UNION ALL SELECT 'e2', 'completed', 'rule', round(avg(o_totalprice), 4) FROM orders")
def s13(spark, d):
    mean = table(spark, d, "orders").agg(F.avg("o_totalprice")).first()[0]
    path = scratch_path(spark, "experiments")
    for i in ("e1", "e2"):
        store.append(store.experiment_row(spark, i, "s1", f"run-{i}", "rule", "regression", {"mean_price": mean}), path)
    out = store.read_experiments(spark, path)
    return out.select("id", "status", "results.model", F.round(F.col("results.metrics")["mean_price"], 4).alias("mean_price"))
