"""Scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import scale
from ..preprocess import preprocess
from .base import DIRTY_SQL, dirty_orders, query, rounded, table, union_sql
from .cleaning import MODE

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber"]


def lines(spark, d):
    return table(spark, d, "lineitem").select(*KEY, *COLS)


def scaled_sql(exprs, stats, source="lineitem", keys="l_orderkey, l_linenumber"):
    cols = ", ".join(f"round({e}, 6) AS {c}" for c, e in exprs.items())
    return f"SELECT {keys}, {cols} FROM {source}, (SELECT {stats} FROM {source})"


def stat(*parts):
    return ", ".join(p.format(c=c) for c in COLS for p in parts)


def run(spark, d, method):
    return rounded(scale.fit_scaler(lines(spark, d), {c: method for c in COLS}).transform(lines(spark, d)))


STD = ("avg({c}) AS m_{c}", "stddev_pop({c}) AS s_{c}")


@query("z1_standard", scaled_sql({c: f"({c} - m_{c}) / s_{c}" for c in COLS}, stat(*STD)))
def z1(spark, d):
    return run(spark, d, "standard")


@query("z2_minmax", scaled_sql({c: f"({c} - a_{c}) / (b_{c} - a_{c})" for c in COLS}, stat("min({c}) AS a_{c}", "max({c}) AS b_{c}")))
def z2(spark, d):
    return run(spark, d, "minmax")


@query("z3_robust", scaled_sql({c: f"({c} - p_{c}[2]) / (p_{c}[3] - p_{c}[1])" for c in COLS}, stat("quantile_cont({c}, [0.25, 0.5, 0.75]) AS p_{c}")))
def z3(spark, d):
    return run(spark, d, "robust")


@query("z4_maxabs", "SELECT c_custkey, round(c_acctbal / (SELECT max(abs(c_acctbal)) FROM customer), 6) AS c_acctbal FROM customer")
def z4(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.fit_scaler(df, {"c_acctbal": "maxabs"}).transform(df))


QUANTILES = """WITH l AS (SELECT unnest(range(1000)) AS i), v AS (SELECT i, (SELECT quantile_cont({c}, list_transform(range(1000), lambda x: x / 999.0)) FROM {t})[i + 1] AS k FROM l),
k AS (SELECT k, min(i) / 999.0 AS lo, max(i) / 999.0 AS hi FROM v GROUP BY k), n AS (SELECT k, lo, hi, lead(k) OVER (ORDER BY k) AS k2, lead(lo) OVER (ORDER BY k) AS lo2 FROM k),
u AS (SELECT {id}, CASE WHEN {c} <= (SELECT min(k) FROM k) THEN 0.0 WHEN {c} >= (SELECT max(k) FROM k) THEN 1.0 WHEN {c} = k THEN (lo + hi) / 2 ELSE hi + ({c} - k) / (k2 - k) * (lo2 - hi) END AS u
 FROM {t} ASOF JOIN n ON {t}.{c} >= n.k)"""


@query("z5_quantile_uniform", QUANTILES.format(c="o_totalprice", t="orders", id="o_orderkey") + " SELECT o_orderkey, round(u, 6) AS o_totalprice FROM u")
def z5(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(scale.fit_scaler(df, {"o_totalprice": "quantile_uniform"}).transform(df))


@query("z5_quantile_ties", QUANTILES.format(c="value", t="events", id="event_id") + " SELECT event_id, round(u, 6) AS value FROM u")
def z5b(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(scale.fit_scaler(df, {"value": "quantile_uniform"}).transform(df))


from ...functions.normal import normal_quantile_sql  # noqa: E402


@query("z6_quantile_normal", QUANTILES.format(c="o_totalprice", t="orders", id="o_orderkey")
       + f" SELECT o_orderkey, round({normal_quantile_sql('w')}, 6) AS o_totalprice FROM (SELECT o_orderkey, greatest(least(u, 1 - 1e-7), 1e-7) AS w FROM u)")
def z6(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rounded(scale.fit_scaler(df, {"o_totalprice": "quantile_normal"}).transform(df))


@query("z7_yeo_johnson")
def z7(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(scale.fit_scaler(df, {"c_acctbal": "power_yeo"}).transform(df), 4)


@query("z7_yeo_johnson_fixed", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS y FROM customer")
def z7b(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", scale.yeo_johnson(F.col("c_acctbal"), 0.5).alias("y")), 4)


@query("z8_box_cox")
def z8(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(scale.fit_scaler(df, {"value": "power_box"}).transform(df), 4)


@query("z8_box_cox_fixed", "SELECT event_id, round((pow(value, 0.25) - 1) / 0.25, 6) AS y FROM events")
def z8b(spark, d):
    return rounded(table(spark, d, "events").select("event_id", scale.box_cox(F.col("value"), 0.25).alias("y")))


@query("z9_normalize_sign", "SELECT c_custkey, CAST(sign(c_acctbal) AS DOUBLE) AS c_acctbal FROM customer")
def z9(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return scale.fit_scaler(df, {"c_acctbal": "normalizer"}).transform(df)


@query("z9_normalize_rows", "SELECT " + ", ".join(KEY) + ", " + ", ".join(f"round({c} / sqrt(" + " + ".join(f"{x} * {x}" for x in COLS) + f"), 6) AS {c}" for c in COLS) + " FROM lineitem")
def z9b(spark, d):
    return rounded(scale.normalize_rows(lines(spark, d), COLS))


def outside(c, t, f=3.0):
    q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM {t})", f"(SELECT quantile_cont({c}, 0.75) FROM {t})"
    return f"bool_or({c} < {q1} - {f} * ({q3} - {q1}) OR {c} > {q3} + {f} * ({q3} - {q1}))"


def shape_sql(c, t):
    return f"""SELECT '{c}' AS column_name, (SELECT avg(pow({c} - m, 3)) / pow(var_pop({c}), 1.5) FROM {t}, (SELECT avg({c}) AS m FROM {t}) GROUP BY m) AS skewness,
    kurtosis_pop({c}) AS kurtosis, {outside(c, t)} AS has_outliers, bool_or({c} < 0) AS has_negative, bool_or({c} = 0) AS has_zero, count(DISTINCT {c}) * 1.0 / count({c}) AS unique_ratio FROM {t}"""


SHAPES = [("value", "events"), ("user_id", "events")]


@query("z10_analyze", "SELECT column_name, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, has_outliers, has_negative, has_zero, round(unique_ratio, 6) AS unique_ratio FROM (" + union_sql([shape_sql(*s) for s in SHAPES]) + ")")
def z10(spark, d):
    return rounded(scale.analyze_columns(table(spark, d, "events"), ["value", "user_id"], test=False).drop("distribution"))


@query("z11_has_outliers", union_sql([f"SELECT '{c}' AS column_name, {outside(c, 'events')} AS has_outliers FROM events" for c in ("value", "user_id")]))
def z11(spark, d):
    return scale.analyze_columns(table(spark, d, "events"), ["value", "user_id"], test=False).select("column_name", "has_outliers")


@query("z12_normality_statistic", """WITH m AS (SELECT count(*)::DOUBLE AS n, (SELECT avg(pow(o_totalprice - a, 3)) FROM orders, (SELECT avg(o_totalprice) AS a FROM orders)) / pow(var_pop(o_totalprice), 1.5) AS g1, kurtosis_pop(o_totalprice) AS g2 FROM orders),
s AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y, -1 + sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) AS w2,
 (g2 + 3 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/(pow(n+1,2)*(n+3)*(n+5))) AS x, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS b1 FROM m),
t AS (SELECT *, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)) AS z1, 6+8/b1*(2/b1+sqrt(1+4/(b1*b1))) AS a FROM s),
u AS (SELECT *, 1 + x*sqrt(2/(a-4)) AS d FROM t)
SELECT 'o_totalprice' AS column_name, round(z1*z1 + pow((1-2/(9*a) - sign(d)*pow((1-2/a)/abs(d), 1.0/3)) / sqrt(2/(9*a)), 2), 4) AS k2 FROM u""")
def z12(spark, d):
    k2, _ = scale.normality(table(spark, d, "orders"), ["o_totalprice"])["o_totalprice"]
    return table(spark, d, "orders").agg(F.lit("o_totalprice").alias("column_name"), F.round(F.lit(k2), 4).alias("k2"))


@query("z12_uniform_distance", """SELECT 'o_totalprice' AS column_name, round(max(greatest(hi / n - c, c - lo / n)), 6) AS distance FROM (
SELECT (o_totalprice - a) / (b - a) AS c, rank() OVER (ORDER BY o_totalprice) - 1 AS lo, count(*) OVER (ORDER BY o_totalprice) AS hi, n FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, count(*) AS n FROM orders))""")
def z12b(spark, d):
    dist, _ = scale.uniformity(table(spark, d, "orders"), "o_totalprice")
    return table(spark, d, "orders").agg(F.lit("o_totalprice").alias("column_name"), F.round(F.lit(dist), 6).alias("distance"))


@query("z12_distribution_tests")
def z12c(spark, d):
    rows = list(scale.distribution_tests(lines(spark, d), COLS).items())
    return spark.createDataFrame(rows, "column_name string, distribution string")


@query("z13_choose", "SELECT column_name, CASE WHEN has_outliers THEN 'robust' WHEN unique_ratio < 0.05 THEN 'minmax' WHEN abs(skewness) > 2 AND has_negative THEN 'power_yeo' WHEN abs(skewness) > 2 AND NOT has_zero THEN 'power_box' WHEN abs(skewness) > 2 THEN 'quantile_normal' ELSE 'standard' END AS method FROM (" + union_sql([shape_sql(*s) for s in SHAPES]) + ")")
def z13(spark, d):
    return scale.analyze_columns(table(spark, d, "events"), ["value", "user_id"]).select("column_name", scale.choice().alias("method"))


@query("z14_fit_transform_auto", "SELECT event_id, round((value - (SELECT quantile_cont(value, 0.5) FROM events)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM events), 6) AS value, round((user_id - (SELECT min(user_id) FROM events)) / (SELECT max(user_id) - min(user_id) FROM events), 6) AS user_id FROM events")
def z14(spark, d):
    df = table(spark, d, "events").select("event_id", "value", "user_id")
    return rounded(scale.fit_scaler(df, "auto", exclude=["event_id"]).transform(df))


@query("z15_inverse", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}, 4) AS {c}" for c in COLS) + " FROM lineitem")
def z15(spark, d):
    df = lines(spark, d)
    methods = dict(zip(COLS, ["standard", "power_box", "robust", "minmax"]))
    fitted = scale.fit_scaler(df, methods)
    return rounded(fitted.inverse_transform(fitted.transform(df)), 4)


@query("z16_group_scaler", scaled_sql({"l_quantity": "(l_quantity - a_q) / (b_q - a_q)", "l_extendedprice": "(l_extendedprice - m_e) / s_e", "l_discount": "l_discount", "l_tax": "(l_tax - m_t) / s_t"},
       "min(l_quantity) AS a_q, max(l_quantity) AS b_q, avg(l_extendedprice) AS m_e, stddev_pop(l_extendedprice) AS s_e, avg(l_tax) AS m_t, stddev_pop(l_tax) AS s_t"))
def z16(spark, d):
    df = lines(spark, d)
    groups = {"minmax": ["l_quantity"], "none": ["l_discount", *KEY]}
    return rounded(scale.fit_group_scaler(df, groups).transform(df))


W = "greatest((SELECT quantile_cont(value, 0.05) FROM events), least((SELECT quantile_cont(value, 0.95) FROM events), value))"


@query("z17_winsor_standard", f"WITH w AS (SELECT event_id, {W} AS w FROM events) SELECT event_id, round((w - (SELECT avg(w) FROM w)) / (SELECT stddev_pop(w) FROM w), 6) AS value FROM w")
def z17(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(scale.fit_winsor_scaler(df, ["value"]).transform(df))


@query("z18_recommend", f"""SELECT 'global' AS scope, CASE WHEN v OR u THEN 'robust' ELSE 'standard' END AS method, CASE WHEN v OR u THEN 'outliers would dominate a linear fit' ELSE 'no outliers to guard against' END AS reason
FROM (SELECT {outside('value', 'events')} AS v, {outside('user_id', 'events')} AS u FROM events)
UNION ALL SELECT column_name, CASE WHEN has_outliers THEN 'robust' WHEN unique_ratio < 0.05 THEN 'minmax' ELSE 'standard' END, 'column distribution' FROM (""" + union_sql([shape_sql(*s) for s in SHAPES]) + ")")
def z18(spark, d):
    return scale.recommend_scaling(table(spark, d, "events"), "linear", ["value", "user_id"])


@query("z19_scaling_report", union_sql([f"SELECT '{c}' AS column_name, '{m}' AS method, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 6) AS std, format('[{{:.2f}}, {{:.2f}}]', min({c}), max({c})) AS range, {outside(c, 'lineitem')} AS has_outliers FROM lineitem"
    for c, m in [("l_quantity", "minmax"), ("l_extendedprice", "standard")]]))
def z19(spark, d):
    df = lines(spark, d)
    fitted = scale.fit_scaler(df, {"l_quantity": "minmax", "l_extendedprice": "standard"})
    return rounded(rounded(scale.scaling_report(df, fitted), 4, ["mean"]), 6, ["std"])


Z20_SQL = (
    f"""WITH {DIRTY_SQL}, u AS (SELECT DISTINCT * FROM dirty),
k AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, coalesce(o_orderpriority, {MODE.format(t='u')}) AS o_orderpriority FROM u)
SELECT o_orderkey, o_totalprice, round((o_custkey - m) / s, 6) AS o_custkey,
""" + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS \"o_orderstatus_{v}\"" for v in "OP") + ", "
    + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS \"o_orderpriority_{v}\"" for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    + " FROM k, (SELECT avg(o_custkey) AS m, stddev_pop(o_custkey) AS s FROM k)"
)


@query("z20_preprocess", Z20_SQL)
def z20(spark, d):
    return rounded(preprocess(dirty_orders(spark, d), target="o_totalprice", preset="standard", keep=["o_orderkey"]))
