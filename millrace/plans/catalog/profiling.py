"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import association, distribution, profile, target
from ...operators.reports import bundle_rows
from .base import DIRTY_COLUMNS, DIRTY_SQL, ORACLES, dirty_orders, query, rounded, table, union_sql
from ..eda import eda_report

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIRTY_NUM = ["o_orderkey", "o_custkey", "o_totalprice", "mostly_null", "const"]
DIRTY_STR = ["o_orderstatus", "o_orderpriority"]
DIRTY_TYPES = dict(zip(DIRTY_COLUMNS, ["bigint", "bigint", "string", "double", "string", "bigint", "bigint"]))
CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
WITH = f"WITH {DIRTY_SQL}\n"


def each(columns, body, source):
    """One SELECT per column, {c} being its name."""
    return union_sql([f"SELECT '{c}' AS column_name, {body.format(c=c)} FROM {source}" for c in columns])


@query("p1_dataset_info", union_sql([
    f"SELECT (SELECT count(*) FROM customer) AS n_rows, CAST(5 AS BIGINT) AS n_columns, '{c}' AS column_name, '{t}' AS type"
    for c, t in CUSTOMER.items()]))
def p1(spark, d):
    return profile.dataset_info(table(spark, d, "customer"))


SUMMARY = ("count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 6) AS std, "
           "round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
           "round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS median, "
           "round(quantile_cont({c}, 0.75), 6) AS q75")


@query("p2_numeric_summary", each(LINE_NUM, SUMMARY + ", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_unique", "lineitem"))
def p2(spark, d):
    return rounded(rounded(profile.numeric_summary(table(spark, d, "lineitem"), LINE_NUM), 4, ["mean"]))


@query("p2_numeric_summary_missing", WITH + each(DIRTY_NUM, SUMMARY + ", count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_unique", "dirty"))
def p2b(spark, d):
    return rounded(rounded(profile.numeric_summary(dirty_orders(spark, d), DIRTY_NUM), 4, ["mean"]))


@query("p3_categorical_summary", WITH + union_sql([
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, count(*) - count({c}) AS missing,
    (SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_frequent,
    (SELECT count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 1) AS most_frequent_count
    FROM dirty""" for c in DIRTY_STR]))
def p3(spark, d):
    return profile.categorical_summary(dirty_orders(spark, d), DIRTY_STR)


@query("p3_top_values", union_sql([
    f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
    {c} AS value, count(*) AS n FROM part GROUP BY {c}) WHERE rank <= 5""" for c in ("p_brand", "p_type", "p_name")]))
def p3b(spark, d):
    return profile.top_values(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


@query("p4_describe", each(["value", "user_id"], SUMMARY, "events"))
def p4(spark, d):
    return rounded(rounded(profile.describe(table(spark, d, "events"), ["value", "user_id"]), 4, ["mean"]))


@query("p5_missing_report", WITH + "SELECT * FROM (" + each(DIRTY_COLUMNS, "count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct", "dirty") + ") WHERE missing > 0")
def p5(spark, d):
    return rounded(profile.missing_report(dirty_orders(spark, d)))


@query("p6_column_info", WITH + union_sql([
    f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM dirty"
    for c, t in DIRTY_TYPES.items()]))
def p6(spark, d):
    return rounded(profile.column_info(dirty_orders(spark, d)))


@query("p7_schema_table", WITH + union_sql([
    f"SELECT '{c}' AS column_name, '{t}' AS type, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique FROM dirty"
    for c, t in DIRTY_TYPES.items()]))
def p7(spark, d):
    return profile.schema_table(dirty_orders(spark, d))


@query("p8_duplicate_rows", WITH + """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
round(100.0 * sum(n - 1) / sum(n), 6) AS duplicate_pct FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, mostly_null, const)""".replace("GROUP BY ALL, ", "GROUP BY "))
def p8(spark, d):
    return rounded(profile.duplicate_rows(dirty_orders(spark, d)))


@query("p8_duplicate_columns", """WITH w AS (SELECT p_partkey, p_size, p_partkey AS key_copy, p_brand FROM part)
SELECT 'p_partkey' AS left_column, 'key_copy' AS right_column FROM w HAVING count(*) FILTER (WHERE p_partkey IS DISTINCT FROM key_copy) = 0""")
def p8b(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("key_copy"), "p_brand")
    return profile.duplicate_columns(df)


@query("p9_constant_columns", WITH + "SELECT * FROM (" + each(DIRTY_COLUMNS, "count(DISTINCT {c}) AS n_unique", "dirty") + ") WHERE n_unique <= 1")
def p9(spark, d):
    return profile.constant_columns(dirty_orders(spark, d))


@query("p10_high_cardinality", "SELECT * FROM (" + each(["c_name", "c_mktsegment"], "count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) * 1.0 / count(*), 6) AS ratio", "customer") + ") WHERE ratio > 0.9")
def p10(spark, d):
    return rounded(profile.high_cardinality_columns(table(spark, d, "customer")))


def outlier_sql(columns, source, having=True):
    body = union_sql([
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers,
        round(100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count(*), 6) AS outlier_pct,
        round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper
        FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
          (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))""" for c in columns])
    return f"SELECT * FROM ({body})" + (" WHERE outliers > 0" if having else "")


@query("p11_outlier_report", outlier_sql(LINE_NUM, "lineitem", having=False))
def p11(spark, d):
    return rounded(profile.outlier_report(table(spark, d, "lineitem"), LINE_NUM, every=True))


@query("p11_outlier_columns", WITH + outlier_sql(DIRTY_NUM, "dirty"))
def p11b(spark, d):
    return rounded(profile.outlier_report(dirty_orders(spark, d), DIRTY_NUM))


@query("p12_critical_issues", WITH + """, m AS (SELECT 100.0 * (count(*) - count(mostly_null)) / count(*) AS pct FROM dirty),
g AS (SELECT 100.0 * sum(n - 1) / sum(n) AS pct FROM (SELECT count(*) AS n FROM dirty GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, mostly_null, const))
SELECT 'missing' AS issue, format('mostly_null: {:.1f}% of values missing', pct) AS detail FROM m WHERE pct > 85
UNION ALL SELECT 'duplicates', format('{:.1f}% of rows are duplicates', pct) FROM g WHERE pct > 1""".replace("\n, m", ", m"))
def p12(spark, d):
    return profile.critical_issues(dirty_orders(spark, d), missing_pct=85.0, duplicate_pct=1.0)


@query("p13_type_conformance", each(["c_name", "c_mktsegment", "phone"],
    "count({c}) AS non_null, count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS not_numeric, "
    "round(100.0 * count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) / count({c}), 6) AS not_numeric_pct",
    "(SELECT c_name, c_mktsegment, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS phone FROM customer)"))
def p13(spark, d):
    phone = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    df = table(spark, d, "customer").select("c_name", "c_mktsegment", phone.alias("phone"))
    return rounded(profile.type_conformance(df))


@query("p14_target_classes", """WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderpriority' AS target, 'classification' AS problem_type, count(v) AS n_unique,
CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS missing, round(max(n) * 1.0 / min(n), 6) AS imbalance_ratio,
max(n) * 1.0 / min(n) > 10 AS imbalanced FROM c""")
def p14(spark, d):
    return rounded(target.analyze_target(table(spark, d, "orders"), "o_orderpriority"))


@query("p14_target_numeric", """SELECT 'value' AS target,
CASE WHEN count(DISTINCT value) * 1.0 / count(*) < 0.05 AND count(DISTINCT value) < 20 THEN 'classification' ELSE 'regression' END AS problem_type,
count(DISTINCT value) AS n_unique, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
round(min(value), 6) AS min, round(max(value), 6) AS max, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events""")
def p14b(spark, d):
    return rounded(target.analyze_target(table(spark, d, "events"), "value"))


@query("p14_class_distribution", "SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS n FROM labels GROUP BY 1")
def p14c(spark, d):
    return target.class_distribution(table(spark, d, "labels"), "toxic")


@query("p15_feature_roles", WITH + union_sql([
    f"""SELECT '{c}' AS column_name, '{"categorical" if DIRTY_TYPES[c] == "string" else "numeric"}' AS role,
    {"false" if DIRTY_TYPES[c] == "string" else f"coalesce(stddev_samp({c}) < 0.01, false)"} AS low_variance,
    {f"count(DISTINCT {c}) > 50 OR count(DISTINCT {c}) * 1.0 / count(*) > 0.5" if DIRTY_TYPES[c] == "string" else "false"} AS high_cardinality,
    count(DISTINCT {c}) <= 1 AS constant FROM dirty""" for c in DIRTY_COLUMNS if c != "o_totalprice"]))
def p15(spark, d):
    return profile.feature_roles(dirty_orders(spark, d), "o_totalprice")


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "gross"), ("l_extendedprice", "gross")]
GROSS = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 + l_tax) AS gross FROM lineitem)"


@query("p16_correlated_pairs", "SELECT * FROM (" + union_sql([
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS r FROM {GROSS}" for a, b in PAIRS]) + ") WHERE abs(r) > 0.95")
def p16(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"))
    return rounded(association.correlated_pairs(df))


@query("p17_varying_scales", "WITH s AS (" + union_sql([f"SELECT CAST(max({c}) - min({c}) AS DOUBLE) AS r FROM lineitem" for c in LINE_NUM]) + """)
SELECT round(max(r), 6) AS max_range, round(min(r), 6) AS min_range, round(max(r) / (min(r) + 1e-10), 4) AS ratio, max(r) / (min(r) + 1e-10) > 1000 AS varying FROM s""")
def p17(spark, d):
    df = rounded(profile.varying_scales(table(spark, d, "lineitem"), LINE_NUM), 6, ["max_range", "min_range"])
    return rounded(df, 4, ["ratio"])


@query("p18_correlation_pearson", WITH + union_sql([
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr({a}, {b}), 6) AS r FROM dirty"
    for a, b in [("o_custkey", "o_totalprice"), ("o_custkey", "mostly_null"), ("o_totalprice", "mostly_null")]]))
def p18(spark, d):
    return rounded(association.correlation_matrix(dirty_orders(spark, d), ["o_custkey", "o_totalprice", "mostly_null"]))


def spearman_sql(a, b, source):
    return f"""SELECT '{a}' AS left_column, '{b}' AS right_column, round(corr(ra, rb), 6) AS r FROM (
      SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
      FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


TRIPLE = ["l_quantity", "l_extendedprice", "l_discount"]


@query("p18_correlation_spearman", union_sql([spearman_sql(a, b, "lineitem") for a, b in [(TRIPLE[0], TRIPLE[1]), (TRIPLE[0], TRIPLE[2]), (TRIPLE[1], TRIPLE[2])]]))
def p18b(spark, d):
    return rounded(association.correlation_matrix(table(spark, d, "lineitem"), TRIPLE, "spearman"))


@query("p18_correlation_kendall", """WITH c AS (SELECT p_size AS x, p_retailprice AS y FROM part),
s AS (SELECT sum(CASE WHEN a.x < b.x AND a.y < b.y THEN 1 WHEN a.x < b.x AND a.y > b.y THEN -1 ELSE 0 END) AS s FROM c a, c b),
n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM c),
tx AS (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT count(*) AS t FROM c GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT count(*) AS t FROM c GROUP BY y))
SELECT 'p_size' AS left_column, 'p_retailprice' AS right_column, round(s / sqrt((n0 - n1) * (n0 - n2)), 6) AS r FROM s, n, tx, ty""")
def p18c(spark, d):
    return rounded(association.correlation_matrix(table(spark, d, "part"), ["p_size", "p_retailprice"], "kendall"))


def histogram_sql(c, source, bins, extra=""):
    return f"""SELECT bin, round(lo + w * bin, 6) AS lower, round(lo + w * (bin + 1), 6) AS upper, count(v) AS n {extra}
    FROM (SELECT unnest(range({bins})) AS bin) b,
         (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins}.0 AS w FROM {source}) r
    LEFT JOIN (SELECT {c} AS v, (SELECT min({c}) FROM {source}) AS l2, (SELECT (max({c}) - min({c})) / {bins}.0 FROM {source}) AS w2 FROM {source}) x
      ON least(CAST(floor((v - l2) / w2) AS BIGINT), {bins - 1}) = b.bin
    GROUP BY bin, lo, w"""


@query("p19_histogram", union_sql([f"SELECT '{c}' AS column_name, * FROM ({histogram_sql(c, t, 30)})" for c, t in [("l_extendedprice", "lineitem"), ("l_quantity", "lineitem")]]))
def p19(spark, d):
    return rounded(distribution.histogram(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"]))


@query("p20_density", """WITH s AS (SELECT count(*) AS n, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
g AS (SELECT point, lo + point * ((hi - lo) / 99) AS x, n, sd * pow(n, -0.2) AS h, (hi - lo) / 30 AS w FROM s, (SELECT unnest(range(100)) AS point))
SELECT point, round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - o_totalprice) / h, 2))) * w / (h * sqrt(2 * pi())), 4) AS y
FROM g, orders GROUP BY point, x, h, w""")
def p20(spark, d):
    return rounded(distribution.density(table(spark, d, "orders"), "o_totalprice"), 4)


@query("p21_target_classes", "SELECT o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1")
def p21(spark, d):
    return distribution.target_distribution(table(spark, d, "orders"), "o_orderstatus", "classification")


@query("p21_target_histogram", f"SELECT *, (SELECT round(avg(o_totalprice), 6) FROM orders) AS mean, (SELECT round(quantile_cont(o_totalprice, 0.5), 6) FROM orders) AS median FROM ({histogram_sql('o_totalprice', 'orders', 50)})")
def p21b(spark, d):
    return rounded(distribution.target_distribution(table(spark, d, "orders"), "o_totalprice", "regression"))


@query("p22_target_candidates", "WITH c AS (" + union_sql([
    f"""SELECT '{c}' AS column_name, {i} AS position, '{t}' AS type, count(DISTINCT {c}) AS n_unique,
    count(*) - count({c}) AS missing, count(*) AS n_rows FROM customer""" for i, (c, t) in enumerate(CUSTOMER.items())]) + """),
s AS (SELECT *, CASE WHEN column_name LIKE '%target%' OR column_name LIKE '%label%' OR column_name LIKE '%class%' OR column_name LIKE '%y%'
   OR column_name LIKE '%outcome%' OR column_name LIKE '%result%' THEN 30 ELSE 0 END + CASE WHEN position = 4 THEN 10 ELSE 0 END
   + CASE WHEN n_unique = 2 THEN 20 WHEN n_unique BETWEEN 3 AND 20 AND type = 'string' THEN 15
     WHEN type <> 'string' AND n_unique * 1.0 / n_rows > 0.1 AND n_unique * 1.0 / n_rows < 0.9 THEN 10 ELSE 0 END AS score FROM c)
SELECT column_name, score, type, n_unique, missing FROM s WHERE score > 0 ORDER BY score DESC, position LIMIT 5""")
def p22(spark, d):
    return target.target_candidates(table(spark, d, "customer"))


@query("p23_recommend_cleaning", WITH + """, m AS (SELECT * FROM (""" + each(DIRTY_COLUMNS, "100.0 * (count(*) - count({c})) / count(*) AS pct", "dirty") + """)),
o AS (""" + outlier_sql(DIRTY_NUM, "dirty") + """), u AS (""" + each(DIRTY_COLUMNS, "count(DISTINCT {c}) AS n", "dirty") + """),
sp AS (""" + union_sql([f"SELECT max({c}) - min({c}) AS r FROM dirty" for c in DIRTY_NUM]) + """)
SELECT 'high' AS priority, 1 AS rule, 'drop_column' AS action, column_name, CAST(NULL AS VARCHAR) AS strategy, format('{:.1f}% of the cells are missing, too many to fill', pct) AS reason FROM m WHERE pct > 50
UNION ALL SELECT 'medium', 2, 'impute', column_name, CASE WHEN column_name IN ('o_orderkey','o_custkey','o_totalprice','mostly_null','const') THEN 'mean' ELSE 'mode' END, format('{:.1f}% of the cells are missing', pct) FROM m WHERE pct > 0 AND pct <= 50
UNION ALL SELECT 'medium', 3, 'handle_outliers', column_name, 'clip', format('{:.1f}% of the values are outliers', outlier_pct) FROM o WHERE outlier_pct > 5
UNION ALL SELECT 'high', 4, 'encode_categorical', column_name, 'target_encoding', 'many distinct texts' FROM u WHERE column_name IN ('o_orderstatus', 'o_orderpriority') AND n > 50
UNION ALL SELECT 'high', 5, 'scale_features', NULL, 'standard', 'ranges differ a thousandfold' FROM sp HAVING max(r) / (min(r) + 1e-10) > 1000
UNION ALL SELECT 'high', 6, 'drop_column', column_name, NULL, 'a single value' FROM u WHERE n <= 1""")
def p23(spark, d):
    return target.recommend_cleaning(dirty_orders(spark, d))


@query("p24_recommend_overall", WITH + """, o AS (SELECT coalesce(sum(outliers), 0) AS n FROM (""" + outlier_sql(DIRTY_NUM, "dirty", False) + """)),
g AS (SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM dirty GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, mostly_null, const)),
m AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM (""" + each(DIRTY_COLUMNS, "count(*) - count({c}) AS n", "dirty") + """))
SELECT 'cleaning' AS section, 'total_missing' AS item, CAST(n AS VARCHAR) AS value FROM m
UNION ALL SELECT 'cleaning', 'outliers_needed', CAST(n > 0 AS VARCHAR) FROM o
UNION ALL SELECT 'cleaning', 'outlier_method', 'iqr'
UNION ALL SELECT 'cleaning', 'duplicates_needed', CAST(n > 0 AS VARCHAR) FROM g
UNION ALL SELECT 'cleaning', 'duplicate_count', CAST(n AS VARCHAR) FROM g
UNION ALL SELECT 'scaling', 'strategy', CASE WHEN n > 0 THEN 'robust' ELSE 'standard' END FROM o""")
def p24(spark, d):
    return target.recommend_overall(dirty_orders(spark, d))


@query("p25_validate_target", WITH + union_sql([
    "SELECT 'o_orderstatus' AS target, true AS ok, CAST(NULL AS VARCHAR) AS message FROM orders HAVING count(DISTINCT o_orderstatus) BETWEEN 2 AND 100",
    "SELECT 'o_orderpriority', false, (count(*) - count(o_orderpriority)) || ' rows lack the target' FROM dirty",
    "SELECT 'o_custkey', false, count(DISTINCT o_custkey) || ' classes are too many; treat the target as a number' FROM dirty",
    "SELECT 'const', false, 'target never varies' FROM dirty HAVING stddev_samp(const) = 0",
    "SELECT 'o_orderstatus:regression', false, 'target is no number'"]))
def p25(spark, d):
    df = dirty_orders(spark, d)
    asks = [("o_orderstatus", "classification", "o_orderstatus"), ("o_orderpriority", "classification", "o_orderpriority"),
            ("o_custkey", "classification", "o_custkey"), ("const", "regression", "const"),
            ("o_orderstatus", "regression", "o_orderstatus:regression")]
    out = None
    for column, kind, name in asks:
        row = target.validate_target(df, column, kind).select(F.lit(name).alias("target"), "ok", "message")
        out = row if out is None else out.unionByName(row)
    return out


@query("p26_pattern_conformance", union_sql([
    f"""SELECT '{c}' AS column_name, '{n}' AS pattern, count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS matches,
    count(*) FILTER (WHERE NOT regexp_matches({c}, '{p}')) AS mismatches FROM documents"""
    for c in ("text", "lang", "source") for n, p in profile.PATTERNS.items()]))
def p26(spark, d):
    return profile.pattern_conformance(table(spark, d, "documents"), profile.PATTERNS)


def narrow_sql(c, t, source):
    ints = "".join(f" WHEN w = 0 AND lo >= -{2 ** b} AND hi < {2 ** b} THEN '{k}'" for k, b in profile.INT_TYPES)
    return f"""SELECT '{c}' AS column_name, '{t}' AS type, CASE WHEN lo IS NULL THEN '{t}'{ints} WHEN w = 0 THEN 'bigint' WHEN f = 0 THEN 'float' ELSE '{t}' END AS narrow_type
    FROM (SELECT min({c}) AS lo, max({c}) AS hi, count(*) FILTER (WHERE floor({c}) <> {c}) AS w, count(*) FILTER (WHERE CAST(CAST({c} AS FLOAT) AS DOUBLE) <> {c}) AS f FROM {source})"""


@query("p27_narrow_types", union_sql([narrow_sql(c, t, "lineitem") for c, t in [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")]]))
def p27(spark, d):
    return profile.narrow_types(table(spark, d, "lineitem"))


def section_sql(section, key, columns, source):
    return union_sql([f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in columns])


EDA = ["o_custkey", "o_totalprice"]


@query("p28_eda_report", WITH + union_sql([
    section_sql("distributions", "column_name || '/' || bin", ["lower", "upper", "n"],
                union_sql([f"SELECT '{c}' AS column_name, * FROM ({histogram_sql(c, 'dirty', 30)})" for c in EDA])),
    section_sql("missing", "column_name", ["missing", "missing_pct"], ORACLES["p5_missing_report"]),
    section_sql("correlations", "'o_custkey/o_totalprice'", ["r"], "SELECT round(corr(o_custkey, o_totalprice), 6) AS r FROM dirty"),
    section_sql("target", "bin", ["lower", "upper", "n", "mean", "median"],
                f"SELECT *, (SELECT round(avg(o_totalprice), 6) FROM dirty) AS mean, (SELECT round(quantile_cont(o_totalprice, 0.5), 6) FROM dirty) AS median FROM ({histogram_sql('o_totalprice', 'dirty', 50)})")]))
def p28(spark, d):
    """All sections of the report, one row for each value."""
    parts = eda_report(dirty_orders(spark, d), "o_totalprice", EDA)
    keys = {"distributions": ["column_name", "bin"], "missing": ["column_name"], "correlations": ["left_column", "right_column"], "target": ["bin"]}
    return bundle_rows({k: rounded(v) for k, v in parts.items()}, keys)
