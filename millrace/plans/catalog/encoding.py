"""Encoding and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import encode, features
from .base import DIRTY_SQL, dirty_orders, query, rounded, table, union_sql

WITH = f"WITH {DIRTY_SQL}\n"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUS = ["F", "O", "P"]


def indicators(column, values):
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS \"{column}_{v}\"" for v in values)


@query("e1_onehot", WITH + f"SELECT o_orderkey, {indicators('o_orderpriority', PRIORITIES[1:])} FROM dirty")
def e1(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return encode.fit_onehot(df).transform(df)


CODES = "(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM {t}))"


@query("e2_onehot_or_label", f"""SELECT o_orderkey, {indicators('o_orderstatus', STATUS)}, CAST(code AS INTEGER) AS customer
FROM orders JOIN {CODES.format(c="'c' || o_custkey", t="orders")} ON v = 'c' || o_custkey""")
def e2(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"))
    return encode.fit_onehot_or_label(df).transform(df)


@query("e3_label", WITH + f"""SELECT o_orderkey, CAST(code AS INTEGER) AS o_orderpriority FROM dirty
JOIN {CODES.format(c="coalesce(o_orderpriority, 'unknown')", t="dirty")} ON v = coalesce(o_orderpriority, 'unknown')""")
def e3(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return encode.fit_labels(df, "o_orderpriority").transform(df)


@query("e4_label_unseen", f"""SELECT p_partkey, CAST(coalesce(code, -1) AS INTEGER) AS p_brand FROM part
LEFT JOIN {CODES.format(c="p_brand", t="(SELECT * FROM part WHERE p_type = 'ECONOMY' AND p_size < 10)")} ON v = p_brand""")
def e4(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    fitted = encode.fit_labels(df.where("p_type = 'ECONOMY' AND p_size < 10"), "p_brand")
    return fitted.transform(df.select("p_partkey", "p_brand"))


@query("e5_target_mean", """SELECT p_partkey, round(prior * (1 - w) + m * w, 6) AS p_brand FROM part JOIN
(SELECT p_brand, avg(p_retailprice) AS m, 1 / (1 + exp(-(count(*) - 20) / 1.0)) AS w FROM part GROUP BY 1) USING (p_brand), (SELECT avg(p_retailprice) AS prior FROM part)""")
def e5(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(encode.fit_target_means(df, "p_brand", "p_retailprice").transform(df).drop("p_retailprice"))


@query("e6_binary", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS l_linestatus FROM lineitem")
def e6(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return encode.fit_binary(df, "l_linestatus").transform(df)


@query("e7_frequency", WITH + """SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority IS NOT NULL THEN count(*) OVER (PARTITION BY o_orderpriority) END AS o_orderpriority_frequency FROM dirty""")
def e7(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return encode.fit_frequency(df, "o_orderpriority").transform(df)


def bucket_sql(c):
    h = f"md5('{c}=' || {c})"
    return f"CAST('0x' || substr({h}, 1, 8) AS BIGINT) % 32", f"CASE WHEN substr({h}, 9, 1) IN ('0','1','2','3','4','5','6','7') THEN 1 ELSE -1 END"


B1, S1 = bucket_sql("p_brand")
B2, S2 = bucket_sql("p_type")


@query("e8_hash_buckets", "SELECT p_partkey, " + ", ".join(
    f"CASE WHEN {B1} = {j} THEN {S1} ELSE 0 END + CASE WHEN {B2} = {j} THEN {S2} ELSE 0 END AS h{j}" for j in range(32)) + " FROM part")
def e8(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return encode.hash_buckets(df, ["p_brand", "p_type"]).drop("p_brand", "p_type")


@query("e8_hash_features")
def e8b(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return encode.hash_features(df, ["p_brand", "p_type"]).select("p_partkey", F.to_json("hashed").alias("hashed"))


@query("e9_auto_encoding", "WITH n AS (" + union_sql([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM {t}" for c, t in
    [("l_linestatus", "lineitem"), ("l_returnflag", "lineitem"), ("l_ship", "(SELECT CAST(l_suppkey % 40 AS VARCHAR) AS l_ship FROM lineitem)"),
     ("l_part", "(SELECT CAST(l_partkey AS VARCHAR) AS l_part FROM lineitem)")]]) + """)
SELECT column_name, CASE WHEN n = 2 THEN 'binary' WHEN n <= 10 THEN 'onehot' WHEN n <= 50 THEN 'target' ELSE 'label' END AS method, n AS categories FROM n""")
def e9(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_linestatus", "l_returnflag", (F.col("l_suppkey") % 40).cast("string").alias("l_ship"),
        F.col("l_partkey").cast("string").alias("l_part"), "l_quantity")
    sizes = encode.distinct_counts(df, df.columns[:4])
    rows = [(c, encode.choose_encoding(n, True), n) for c, n in sizes.items()]
    return spark.createDataFrame(rows, "column_name string, method string, categories long")


@query("e9_auto_transform", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus,
CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N", CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R",
round(prior * (1 - w) + m * w, 4) AS quantity_class, l_extendedprice FROM lineitem JOIN (SELECT l_quantity AS s, avg(l_extendedprice) AS m,
1 / (1 + exp(-(count(*) - 20) / 1.0)) AS w FROM lineitem GROUP BY 1) ON s = l_quantity, (SELECT avg(l_extendedprice) AS prior FROM lineitem)""")
def e9b(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag",
        F.col("l_quantity").cast("int").cast("string").alias("quantity_class"), "l_extendedprice")
    return rounded(encode.fit_encoder(df, target="l_extendedprice").transform(df), 4, ["quantity_class"])


@query("e10_encoding_report", """SELECT 'o_orderstatus' AS column_name, 'onehot' AS method, count(DISTINCT o_orderstatus) - 1 AS categories, count(DISTINCT o_orderstatus) - 1 AS features FROM orders
UNION ALL SELECT 'o_orderpriority', 'onehot', count(DISTINCT o_orderpriority) - 1, count(DISTINCT o_orderpriority) - 1 FROM orders""")
def e10(spark, d):
    return encode.fit_encoder(table(spark, d, "orders"), strategy="onehot").report(spark)


@query("e11_date_features", """SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_weekday,
hour(ts) AS ts_hour, quarter(ts) AS ts_quarter, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts_is_weekend FROM events""")
def e11(spark, d):
    return features.date_features(table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')"


@query("e12_text_counts", f"SELECT doc_id, length(text) AS text_chars, len({WORDS}) AS text_words, len(list_distinct({WORDS})) AS text_unique_words FROM documents")
def e12(spark, d):
    return features.text_counts(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("e12_tf_idf", f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT doc_id, term, tf, df, round(tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)), 6) AS tf_idf FROM tf JOIN df USING (term)""")
def e12b(spark, d):
    return rounded(features.tf_idf(table(spark, d, "documents"), "doc_id", "text"))


@query("e13_polynomial", """SELECT l_quantity, l_tax, round(l_quantity * l_quantity, 6) AS "l_quantity*l_quantity", round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_tax * l_tax, 6) AS "l_tax*l_tax" FROM lineitem""")
def e13(spark, d):
    return rounded(features.polynomial_features(table(spark, d, "lineitem").select("l_quantity", "l_tax"), ["l_quantity", "l_tax"]))


@query("e14_interactions", """SELECT l_quantity, l_tax, l_discount, round(l_quantity * l_tax, 6) AS "l_quantity*l_tax", round(l_quantity * l_discount, 6) AS "l_quantity*l_discount", round(l_tax * l_discount, 6) AS "l_tax*l_discount" FROM lineitem""")
def e14(spark, d):
    cols = ["l_quantity", "l_tax", "l_discount"]
    return rounded(features.interaction_features(table(spark, d, "lineitem").select(*cols), cols))


@query("e15_bin_equal_width", "SELECT event_id, least(CAST(floor((value - lo) / w) AS BIGINT), 9) AS value_bin FROM events, (SELECT min(value) AS lo, (max(value) - min(value)) / 10 AS w FROM events)")
def e15(spark, d):
    return features.bin_equal_width(table(spark, d, "events").select("event_id", "value"), "value").drop("value")


@query("e15_bin_quantile", "SELECT event_id, CAST(" + " + ".join(f"CASE WHEN value >= q[{i}] THEN 1 ELSE 0 END" for i in range(1, 10)) +
       " AS BIGINT) AS value_bin FROM events, (SELECT quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM events)")
def e15b(spark, d):
    return features.bin_quantile(table(spark, d, "events").select("event_id", "value"), "value").drop("value")


@query("e16_encode_target", f"SELECT c_custkey, c_mktsegment, CAST(code AS INTEGER) AS target, c_mktsegment AS restored FROM customer JOIN {CODES.format(c='c_mktsegment', t='customer')} ON v = c_mktsegment")
def e16(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fitted = encode.fit_labels(df, "c_mktsegment")
    return fitted.inverse(fitted.transform(df, "target"), "target", "restored")


def f_sql(c):
    return f"""SELECT '{c}' AS column_name, round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(v) / (sum(n) - count(*))), 4) AS f_score
    FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS v FROM lineitem GROUP BY 1), (SELECT avg({c}) AS gm FROM lineitem)"""


@query("e17_f_scores", union_sql([f_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def e17(spark, d):
    return rounded(features.f_scores(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag"), 4)


@query("e17_f_regression", union_sql([f"SELECT '{c}' AS column_name, round(pow(corr({c}, l_extendedprice), 2) * (count(*) - 2) / (1 - pow(corr({c}, l_extendedprice), 2)), 4) AS f_score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")]))
def e17b(spark, d):
    return rounded(features.f_scores(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "regression"), 4)


@query("e17_select_k_best", "SELECT l_returnflag, l_quantity FROM (SELECT l_returnflag, l_quantity, l_tax FROM lineitem)")
def e17c(spark, d):
    from ...operators.features import select_k_best

    label = F.when(F.col("l_quantity") > 25, "high").otherwise("low")
    df = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_tax", label.alias("size_class"))
    return select_k_best(df, "size_class", 1).drop("size_class")
