"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import clean, impute, isolation
from .base import DIRTY_SQL, dirty_orders, query, rounded, table

WITH = f"WITH {DIRTY_SQL}\n"


@query("c1_drop_duplicates", WITH + "SELECT DISTINCT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM dirty")
def c1(spark, d):
    return rounded(clean.drop_duplicates(dirty_orders(spark, d)))


@query("c1_keep_first", """SELECT o_orderkey, o_custkey, o_orderstatus FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1""")
def c1b(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.drop_duplicates(df, ["o_custkey", "o_orderstatus"], "first", "o_orderkey")


@query("c1_keep_last", """SELECT o_orderkey, o_custkey, o_orderstatus FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def c1c(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.drop_duplicates(df, ["o_custkey", "o_orderstatus"], "last", "o_orderkey")


@query("c1_keep_none", """SELECT o_orderkey, o_custkey, o_orderstatus FROM
(SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders) WHERE n = 1""")
def c1d(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.drop_duplicates(df, ["o_custkey", "o_orderstatus"], "none")


@query("c2_drop_missing", WITH + """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, const
FROM dirty WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""")
def c2(spark, d):
    return rounded(clean.drop_missing(dirty_orders(spark, d), 0.5))


@query("c3_impute_mean", WITH + """SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM dirty)), 4) AS o_totalprice,
coalesce(o_orderpriority, (SELECT o_orderpriority FROM dirty WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM dirty""")
def c3(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rounded(clean.fit_imputer(df, "mean", columns=df.columns[1:]).transform(df), 4)


@query("c3_impute_mode_constant", WITH + """SELECT o_orderkey, CAST(coalesce(mostly_null, (SELECT mostly_null FROM dirty WHERE mostly_null IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS DOUBLE) AS mostly_null,
coalesce(o_orderpriority, 'missing_value') AS o_orderpriority FROM dirty""")
def c3b(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "mostly_null", "o_orderpriority")
    return clean.fit_imputer(df, "most_frequent", "constant", columns=df.columns[1:]).transform(df)


MEDIAN = "(SELECT quantile_cont(o_totalprice, 0.5) FROM {t})"
MODE = "(SELECT o_orderpriority FROM {t} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
FILLED = """SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(o_totalprice, {m}) AS o_totalprice, coalesce(o_orderpriority, {p}) AS o_orderpriority, const FROM {t}"""


def filled(t):
    return FILLED.format(t=t, m=MEDIAN.format(t=t), p=MODE.format(t=t))


@query("c4_missing_strategy", WITH + f"SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM ({filled('dirty')})")
def c4(spark, d):
    df = dirty_orders(spark, d)
    return rounded(clean.fit_missing(df).transform(df))


@query("c4_missing_aggressive", WITH + "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, const FROM dirty")
def c4b(spark, d):
    df = dirty_orders(spark, d)
    return rounded(clean.fit_missing(df, "o_totalprice", "aggressive").transform(df))


KNN_COLS = ["e1", "e2", "e3", "e4", "e5", "e6"]
KNN_SQL = """WITH e AS (SELECT vec_id, """ + ", ".join(
    f"CASE WHEN vec_id % {7 + i} <> {i} THEN CAST(embedding[{i + 1}] AS DOUBLE) END AS e{i + 1}" for i in range(6)
) + """ FROM embeddings),\n""" + ",\n".join(
    f"""d{j} AS (SELECT q.vec_id, t.e{j} AS v, t.vec_id AS donor, 6.0 / nullif({" + ".join(f"CASE WHEN q.e{i} - t.e{i} IS NULL THEN 0 ELSE 1 END" for i in range(1, 7))}, 0)
   * ({" + ".join(f"coalesce(pow(q.e{i} - t.e{i}, 2), 0)" for i in range(1, 7))}) AS dist
   FROM e q JOIN e t ON q.e{j} IS NULL AND t.e{j} IS NOT NULL),
f{j} AS (SELECT vec_id, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, donor) AS r FROM d{j} WHERE dist IS NOT NULL) WHERE r <= 5 GROUP BY 1)"""
    for j in range(1, 7)
) + "\nSELECT e.vec_id, " + ", ".join(f"round(coalesce(e.e{j}, f{j}.v), 6) AS e{j}" for j in range(1, 7)) + " FROM e " + " ".join(
    f"LEFT JOIN f{j} ON f{j}.vec_id = e.vec_id" for j in range(1, 7))


def holed_embeddings(spark, d):
    """Six coordinates of every embedding, some of them set to NULL by rule."""
    return table(spark, d, "embeddings").select(
        "vec_id",
        *[
            F.when(F.col("vec_id") % (7 + i) != i, F.col("embedding")[i].cast("double")).alias(f"e{i + 1}")
            for i in range(6)
        ],
    )


@query("c5_impute_knn", KNN_SQL)
def c5(spark, d):
    return rounded(impute.impute_knn(holed_embeddings(spark, d), "vec_id", KNN_COLS, k=5))


@query("c6_impute_iterative")
def c6(spark, d):
    return rounded(impute.impute_iterative(holed_embeddings(spark, d), KNN_COLS, rounds=10))


CUT = "(SELECT quantile_cont({c}, {p}) FROM {t})"


def fence(c, t, f):
    q1, q3 = CUT.format(c=c, p=0.25, t=t), CUT.format(c=c, p=0.75, t=t)
    return f"({q1} - {f} * ({q3} - {q1}))", f"({q3} + {f} * ({q3} - {q1}))"


def clipped(c, t, f):
    lo, hi = fence(c, t, f)
    return f"CASE WHEN {c} < {lo} THEN {lo} WHEN {c} > {hi} THEN {hi} ELSE CAST({c} AS DOUBLE) END"


@query("c7_outliers_clip", WITH + f"SELECT o_orderkey, round({clipped('o_totalprice', 'dirty', 1.5)}, 6) AS o_totalprice, round({clipped('o_custkey', 'dirty', 1.5)}, 6) AS o_custkey FROM dirty")
def c7(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(clean.fit_iqr_clip(df, ["o_totalprice", "o_custkey"]).transform(df))


@query("c7_outliers_remove", "WITH a AS (SELECT event_id, value, user_id FROM events WHERE value BETWEEN {0} AND {1}) ".format(*fence("value", "events", 1.5))
       + "SELECT event_id, round(value, 6) AS value, user_id FROM a WHERE user_id BETWEEN {0} AND {1}".format(*fence("user_id", "a", 1.5)))
def c7b(spark, d):
    df = table(spark, d, "events").select("event_id", "value", "user_id")
    return rounded(clean.remove_outliers(df, ["value", "user_id"]))


@query("c8_outliers_fence3", WITH + f"SELECT o_orderkey, round({clipped('o_totalprice', 'dirty', 3.0)}, 6) AS o_totalprice, o_custkey FROM dirty")
def c8(spark, d):
    df = dirty_orders(spark, d).select("o_orderkey", "o_totalprice", "o_custkey")
    out = clean.fit_outliers(df.drop("o_orderkey"), target="o_custkey").transform(df)
    return rounded(out)


@query("c9_isolation_outliers")
def c9(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return isolation.flag_outliers(df, contamination=0.1).groupBy("is_outlier").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean_price"))


@query("c10_drop_constant", WITH + "SELECT * EXCLUDE (const) REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM dirty")
def c10(spark, d):
    return rounded(clean.drop_constant_columns(dirty_orders(spark, d)))


@query("c11_drop_high_cardinality", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def c11(spark, d):
    return clean.drop_high_cardinality_columns(table(spark, d, "customer"))


@query("c12_drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def c12(spark, d):
    return clean.drop_columns(table(spark, d, "customer"), ["c_acctbal", "no_such_column", "c_mktsegment"])


@query("c13_drop_low_variance", "SELECT l_orderkey, l_quantity, l_tax FROM (SELECT l_orderkey, l_quantity, l_tax, 1.0 + l_tax / 1000 AS flat FROM lineitem)")
def c13(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax", (1.0 + F.col("l_tax") / 1000).alias("flat"))
    return clean.drop_low_variance(df, 0.01)


@query("c14_winsorize", "SELECT event_id, round(greatest((SELECT quantile_cont(value, 0.05) FROM events), least((SELECT quantile_cont(value, 0.95) FROM events), value)), 6) AS value FROM events")
def c14(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return rounded(clean.fit_winsorizer(df, ["value"]).transform(df))


U = WITH.rstrip() + ",\nu AS (SELECT DISTINCT * FROM dirty),\nf AS (" + filled("u") + ")"


@query("c15_clean", U + f"""
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, round({clipped('o_totalprice', 'f', 3.0)}, 6) AS o_totalprice, o_orderpriority FROM f""")
def c15(spark, d):
    return rounded(clean.clean(dirty_orders(spark, d)))


LO, HI = fence("o_totalprice", "f", 3.0)


@query("c16_cleaning_report", U + f"""
SELECT 'duplicates' AS step, CAST(NULL AS VARCHAR) AS column_name, (SELECT count(*) FROM dirty) - (SELECT count(*) FROM u) AS n, 'removed' AS detail
UNION ALL SELECT 'missing', 'mostly_null', count(*) - count(mostly_null), 'dropped' FROM u
UNION ALL SELECT 'missing', 'o_totalprice', count(*) - count(o_totalprice), 'median' FROM u
UNION ALL SELECT 'missing', 'o_orderpriority', count(*) - count(o_orderpriority), 'mode' FROM u
UNION ALL SELECT 'outliers', 'o_totalprice', count(*), format('[{{:.2f}}, {{:.2f}}]', {LO}, {HI}) FROM f WHERE o_totalprice < {LO} OR o_totalprice > {HI}
UNION ALL SELECT 'constant', 'const', 1, 'dropped'""")
def c16(spark, d):
    return clean.cleaning_report(dirty_orders(spark, d))


@query("c17_safe_names", """SELECT doc_id, regexp_replace(regexp_extract(source || '/' || lang || ' #' || doc_id || '.txt', '([^/]*)/*$', 1), '[^\\w\\s.-]', '_', 'g') AS name FROM documents""")
def c17(spark, d):
    name = F.concat("source", F.lit("/"), "lang", F.lit(" #"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", clean.safe_name(name).alias("name"))
