"""Evaluation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.normal import normal_quantile_sql
from ...operators import clusters, curves, metrics, reports, residuals, split
from .base import (
    ORACLES,
    PREDS_BIN_SQL,
    PREDS_CLS_SQL,
    PREDS_REG_SQL,
    binary_predictions,
    class_predictions,
    query,
    regression_predictions,
    rounded,
    table,
    union_sql,
)

CLS = f"WITH {PREDS_CLS_SQL}"
BIN = f"WITH {PREDS_BIN_SQL}"
REG = f"WITH {PREDS_REG_SQL}"
PER_CLASS = CLS + """,
cm AS (SELECT label, prediction, count(*) AS n FROM preds GROUP BY ALL),
pc AS (SELECT k AS class, (SELECT coalesce(sum(n), 0) FROM cm WHERE label = k AND prediction = k)::DOUBLE AS tp,
 (SELECT coalesce(sum(n), 0) FROM cm WHERE prediction = k)::DOUBLE AS p, (SELECT coalesce(sum(n), 0) FROM cm WHERE label = k)::DOUBLE AS s
 FROM (SELECT label AS k FROM cm UNION SELECT prediction FROM cm)),
m AS (SELECT class, tp, p, s, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2 * tp / nullif(p + s, 0), 0) AS f1 FROM pc)
"""


def counts(spark, d):
    return metrics.confusion_counts(class_predictions(spark, d))


@query("k1_accuracy", CLS + " SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")
def k1(spark, d):
    return rounded(metrics.accuracy(counts(spark, d)))


@query("k2_averaged_scores", PER_CLASS + union_sql([
    "SELECT 'weighted' AS average, " + ", ".join(f"round(sum({x} * s) / sum(s), 6) AS {x}" for x in metrics.SCORES) + " FROM m",
    "SELECT 'macro', " + ", ".join(f"round(avg({x}), 6)" for x in metrics.SCORES) + " FROM m",
    "SELECT 'micro', round(sum(tp) / sum(p), 6), round(sum(tp) / sum(s), 6), round(2 * sum(tp) / sum(p + s), 6) FROM m",
    "SELECT 'binary', round(precision, 6), round(recall, 6), round(f1, 6) FROM m WHERE class = 1"]))
def k2(spark, d):
    return rounded(metrics.averaged_scores(counts(spark, d)))


@query("k3_classification_report", PER_CLASS + union_sql([
    "SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(s AS BIGINT) AS support FROM m",
    "SELECT 'accuracy', round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM m",
    "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM m",
    "SELECT 'weighted avg', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM m"]))
def k3(spark, d):
    return rounded(metrics.classification_report(counts(spark, d)))


GRID = PER_CLASS + ", g AS (SELECT a.class AS label, b.class AS prediction, coalesce(n, 0)::DOUBLE AS n FROM pc a CROSS JOIN pc b LEFT JOIN cm ON cm.label = a.class AND cm.prediction = b.class) "
NORMS = {"none": "n", "true": "n / sum(n) OVER (PARTITION BY label)", "pred": "n / sum(n) OVER (PARTITION BY prediction)", "all": "n / sum(n) OVER ()"}


@query("k4_confusion_matrix", GRID + union_sql([f"SELECT '{k}' AS normalize, label, prediction, round({e}, 6) AS value FROM g" for k, e in NORMS.items()]))
def k4(spark, d):
    c = counts(spark, d)
    parts = [metrics.confusion_matrix(c, normalize=None if k == "none" else k).select(F.lit(k).alias("normalize"), "*") for k in NORMS]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("k5_mcc", PER_CLASS + "SELECT round((sum(tp) * sum(s) - sum(p * s)) / sqrt((sum(s) * sum(s) - sum(p * p)) * (sum(s) * sum(s) - sum(s * s))), 6) AS mcc FROM m")
def k5(spark, d):
    return rounded(metrics.agreement(counts(spark, d)).select("mcc"))


@query("k6_kappa", PER_CLASS + "SELECT round((sum(tp) / sum(s) - sum(p * s) / (sum(s) * sum(s))) / (1 - sum(p * s) / (sum(s) * sum(s))), 6) AS kappa FROM m")
def k6(spark, d):
    return rounded(metrics.agreement(counts(spark, d)).select("kappa"))


@query("k7_balanced_accuracy", PER_CLASS + "SELECT round(avg(recall) FILTER (WHERE s > 0), 6) AS balanced_accuracy FROM m")
def k7(spark, d):
    return rounded(metrics.agreement(counts(spark, d)).select("balanced_accuracy"))


@query("k8_log_loss", CLS + " SELECT round(avg(-ln(CASE label WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END / (w0 + w1 + w2))), 6) AS log_loss FROM preds")
def k8(spark, d):
    return rounded(metrics.log_loss(class_predictions(spark, d)))


AUC_BIN = """SELECT {k} AS class, sum(CASE WHEN y = 0 THEN above ELSE 0 END) / (sum(y) * sum(1 - y)) AS auc, sum(y) AS support FROM (
 SELECT y, score, sum(y) OVER (ORDER BY score DESC) - sum(y) OVER (PARTITION BY score) / 2.0 AS above FROM (SELECT CAST(label = {v} AS INTEGER) AS y, {s} AS score FROM preds))"""


@query("k9_roc_auc", BIN + " SELECT round(auc, 6) AS auc FROM (" + AUC_BIN.format(k="'1'", v=1, s="score") + ")")
def k9(spark, d):
    points = curves.score_counts(binary_predictions(spark, d), "label", "score")
    return rounded(curves.class_auc(points).select("auc"))


@query("k9_roc_auc_classes", CLS + " SELECT round(sum(auc * support) / sum(support), 6) AS roc_auc FROM (" + union_sql([AUC_BIN.format(k=f"'{k}'", v=k, s=f"w{k} / (w0 + w1 + w2)") for k in range(3)]) + ")")
def k9b(spark, d):
    return rounded(curves.auc(class_predictions(spark, d)))


CURVE = BIN + """, c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM preds GROUP BY 1),
r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, pos FROM c WINDOW w AS (ORDER BY score DESC))
"""


@query("k10_roc_curve", CURVE + "SELECT '1' AS class, round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM r UNION ALL SELECT '1', NULL, 0, 0")
def k10(spark, d):
    return rounded(curves.roc_curve(curves.score_counts(binary_predictions(spark, d), "label", "score")))


@query("k11_precision_recall", CURVE + "SELECT '1' AS class, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM r UNION ALL SELECT '1', NULL, 1, 0")
def k11(spark, d):
    return rounded(curves.precision_recall_curve(curves.score_counts(binary_predictions(spark, d), "label", "score")))


@query("k11_average_precision", CURVE + "SELECT '1' AS class, round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision, round((sum(tp / (tp + fp)) + 1) / (count(*) + 1), 6) AS mean_precision FROM r")
def k11b(spark, d):
    return rounded(curves.precision_summary(curves.score_counts(binary_predictions(spark, d), "label", "score")))


REG_COLS = """round(avg(pow(label - prediction, 2)), 2) AS mse, round(sqrt(avg(pow(label - prediction, 2))), 6) AS rmse, round(avg(abs(label - prediction)), 6) AS mae,
round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 6) AS r2, round(1 - var_pop(label - prediction) / var_pop(label), 6) AS explained_variance,
round(max(abs(label - prediction)), 6) AS max_error, round(100 * avg(abs((label - prediction) / label)) FILTER (WHERE label <> 0), 6) AS mape,
round(avg(label - prediction), 6) AS mean_residual, round(stddev_pop(label - prediction), 6) AS std_residual"""


@query("k12_regression_metrics", REG + f" SELECT {REG_COLS} FROM preds")
def k12(spark, d):
    out = metrics.regression_metrics(regression_predictions(spark, d))
    return rounded(rounded(out, 2, ["mse"]))


@query("k13_mape", REG + " SELECT round(100 * avg(abs((label - prediction) / label)) FILTER (WHERE label <> 0), 6) AS mape FROM preds")
def k13(spark, d):
    return rounded(metrics.regression_metrics(regression_predictions(spark, d)).select("mape"))


@query("k14_adjusted_r2", REG + " SELECT round(1 - (avg(pow(label - prediction, 2)) / var_pop(label)) * (count(*) - 1) / (count(*) - 4 - 1), 6) AS adjusted_r2 FROM preds")
def k14(spark, d):
    return rounded(metrics.regression_metrics(regression_predictions(spark, d), n_features=4).select("adjusted_r2"))


@query("k15_residual_summary", REG + """, e AS (SELECT label - prediction AS e FROM preds), m AS (SELECT avg(e) AS a FROM e)
SELECT round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(min(e), 6) AS min, round(max(e), 6) AS max,
round(avg(pow(e - a, 3)) / pow(var_pop(e), 1.5), 6) AS skewness, round(kurtosis_pop(e), 6) AS kurtosis FROM e, m""")
def k15(spark, d):
    return rounded(metrics.residual_summary(regression_predictions(spark, d)))


@query("k16_durbin_watson", REG + """ SELECT round(sum(pow(e - l, 2)) / sum(e * e), 6) AS durbin_watson FROM
(SELECT label - prediction AS e, lag(label - prediction) OVER (ORDER BY row_id) AS l FROM preds)""")
def k16(spark, d):
    return rounded(residuals.durbin_watson(regression_predictions(spark, d), "row_id"))


@query("k17_breusch_pagan", REG + """ SELECT round(lm, 6) AS lm, lm > 3.841458820694124 AS heteroscedastic FROM
(SELECT count(*) * regr_r2(pow(label - prediction, 2), prediction) AS lm FROM preds)""")
def k17(spark, d):
    return rounded(residuals.breusch_pagan(regression_predictions(spark, d)).select("lm", "heteroscedastic"))


@query("k18_qq_points", REG + f""", r AS (SELECT row_number() OVER (ORDER BY label - prediction) - 1 AS position, label - prediction AS residual, count(*) OVER () AS n FROM preds)
SELECT position, round(residual, 4) AS residual, round((position + 0.5) / n, 6) AS probability, round({normal_quantile_sql('((position + 0.5) / n)')}, 6) AS theoretical FROM r""")
def k18(spark, d):
    return rounded(rounded(residuals.qq_points(regression_predictions(spark, d)), 4, ["residual"]))


@query("k19_scale_location", REG + " SELECT row_id, round(sqrt(abs((label - prediction) / (SELECT stddev_pop(label - prediction) FROM preds))), 6) AS sqrt_abs_standardized FROM preds")
def k19(spark, d):
    return rounded(residuals.scale_location(regression_predictions(spark, d)).select("row_id", "sqrt_abs_standardized"))


@query("k19_residual_histogram", REG + """, e AS (SELECT label - prediction AS e FROM preds), s AS (SELECT min(e) AS lo, (max(e) - min(e)) / 30 AS w FROM e)
SELECT bin, round(lo + w * bin, 4) AS lower, round(lo + w * (bin + 1), 4) AS upper, coalesce(n, 0) AS n FROM s, (SELECT unnest(range(30)) AS bin) b
LEFT JOIN (SELECT least(CAST(floor((e - lo) / w) AS BIGINT), 29) AS bin, count(*) AS n FROM e, s GROUP BY 1) USING (bin)""")
def k19b(spark, d):
    return rounded(residuals.residual_histogram(regression_predictions(spark, d)), 4)


@query("k20_prediction_sample", REG + """ SELECT row_id, label, prediction, round(abs(label - prediction), 6) AS abs_error,
(SELECT round(1 - avg(pow(label - prediction, 2)) / var_pop(label), 6) FROM preds) AS r2 FROM (SELECT row_id, round(label, 6) AS label, round(prediction, 6) AS prediction FROM preds)
ORDER BY md5('42:' || row_id) LIMIT 1000""")
def k20(spark, d):
    return rounded(residuals.prediction_sample(regression_predictions(spark, d), "row_id"))


SIZES = [0.1, 0.25, 0.5, 1.0]


@query("k21_learning_curve", REG + ", r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || row_id)) AS rn, count(*) OVER () AS n FROM preds), t AS (" + union_sql([
    f"SELECT CAST({s} AS DOUBLE) AS size, row_id % 5 AS fold, avg(abs(label - prediction)) AS train_score, max(abs(label - prediction)) AS valid_score FROM r WHERE rn <= floor(n * {s}) GROUP BY 2" for s in SIZES]) + """)
SELECT size, round(avg(train_score), 6) AS train_mean, round(stddev_pop(train_score), 6) AS train_std, round(avg(valid_score), 6) AS valid_mean, round(stddev_pop(valid_score), 6) AS valid_std FROM t GROUP BY size""")
def k21(spark, d):
    df = regression_predictions(spark, d)
    e = F.abs(F.col("label") - F.col("prediction"))
    parts = [
        s.groupBy((F.col("row_id") % 5).alias("fold")).agg(F.avg(e).alias("train_score"), F.max(e).alias("valid_score")).withColumn("size", F.lit(size))
        for size, s in zip(SIZES, split.nested_samples(df, "row_id", SIZES))
    ]
    return rounded(reports.learning_curve_summary(reduce(DataFrame.unionByName, parts)))


EMB = """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
z AS (SELECT c, count(*) AS n FROM e GROUP BY 1)"""


def silhouette_sql(power, name):
    return EMB + f""", p AS (SELECT a.vec_id, a.c AS own, b.c AS other, sum(pow(list_distance(a.x, b.x), {power})) AS t FROM e a, e b GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM p JOIN z ON z.c = p.other GROUP BY 1)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS {name} FROM s"""


@query("k22_silhouette", silhouette_sql(1, "silhouette"))
def k22(spark, d):
    return rounded(clusters.silhouette_score(table(spark, d, "embeddings"), "embedding", "label", "vec_id"))


@query("k22_silhouette_squared", silhouette_sql(2, "silhouette_squared"))
def k22b(spark, d):
    return rounded(clusters.silhouette_squared(table(spark, d, "embeddings"), "embedding", "label"))


CENTROIDS = EMB + """, l AS (SELECT vec_id, c, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM e), m AS (SELECT c, j, avg(v) AS m FROM l GROUP BY ALL), g AS (SELECT j, avg(v) AS g FROM l GROUP BY 1),
w AS (SELECT vec_id, c, sum(pow(v - m, 2)) AS d2 FROM l JOIN m USING (c, j) GROUP BY ALL), k AS (SELECT count(*) AS k, sum(n) AS n FROM z)
"""


@query("k23_calinski_harabasz", CENTROIDS + ", b AS (SELECT sum(n * pow(m - g, 2)) AS b FROM m JOIN g USING (j) JOIN z USING (c)) SELECT round(b / (k - 1) / ((SELECT sum(d2) FROM w) / (n - k)), 6) AS calinski_harabasz FROM b, k")
def k23(spark, d):
    return rounded(clusters.dispersion(table(spark, d, "embeddings"), "embedding", "label").select("calinski_harabasz"))


@query("k24_davies_bouldin", CENTROIDS + """, s AS (SELECT c, avg(sqrt(d2)) AS s FROM w GROUP BY 1),
r AS (SELECT a.c, (sa.s + sb.s) / sqrt(sum(pow(a.m - b.m, 2))) AS r FROM m a JOIN m b ON a.j = b.j AND a.c <> b.c JOIN s sa ON sa.c = a.c JOIN s sb ON sb.c = b.c GROUP BY a.c, b.c, sa.s, sb.s)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT max(r) AS r FROM r GROUP BY c)""")
def k24(spark, d):
    return rounded(clusters.dispersion(table(spark, d, "embeddings"), "embedding", "label").select("davies_bouldin"))


@query("k25_cluster_sizes", EMB + " SELECT c AS cluster, n FROM z")
def k25(spark, d):
    return clusters.cluster_sizes(table(spark, d, "embeddings"), "label")


@query("k25_size_variation", EMB + " SELECT count(*) AS clusters, round(stddev_samp(n) / avg(n), 6) AS size_variation FROM z")
def k25b(spark, d):
    return rounded(clusters.size_variation(table(spark, d, "embeddings"), "label"))


RESULTS = """r AS (SELECT o_orderpriority AS model, 'accuracy' AS metric, avg(o_totalprice / 500000) AS value FROM orders GROUP BY 1
UNION ALL SELECT o_orderpriority, 'f1', avg(o_custkey / 10000.0) FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""


def model_results(spark, d):
    df = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "model")
    a = df.groupBy("model").agg(F.avg(F.col("o_totalprice") / 500000).alias("value")).withColumn("metric", F.lit("accuracy"))
    b = df.where("model <> '5-LOW'").groupBy("model").agg(F.avg(F.col("o_custkey") / 10000.0).alias("value")).withColumn("metric", F.lit("f1"))
    return a.unionByName(b)


@query("k26_model_comparison", f"WITH {RESULTS} SELECT model, round(max(value) FILTER (WHERE metric = 'accuracy'), 6) AS accuracy, round(max(value) FILTER (WHERE metric = 'f1'), 6) AS f1 FROM r GROUP BY 1")
def k26(spark, d):
    return rounded(reports.comparison_table(model_results(spark, d), ["accuracy", "f1"]))


@query("m16_best_model", f"WITH {RESULTS}, w AS (SELECT model, max(value) FILTER (WHERE metric = 'f1') AS v FROM r GROUP BY 1) "
       "SELECT 'max' AS direction, model, round(v, 6) AS value FROM (SELECT * FROM w ORDER BY coalesce(v, 0) DESC, model LIMIT 1) UNION ALL SELECT 'min', model, round(v, 6) FROM (SELECT * FROM w ORDER BY v NULLS LAST, model LIMIT 1)")
def m16(spark, d):
    r = model_results(spark, d)
    best = reports.rank_models(r, "f1").select(F.lit("max").alias("direction"), "*")
    return rounded(best.unionByName(reports.rank_models(r, "f1", minimize=True).select(F.lit("min").alias("direction"), "*")))


@query("k27_evaluate_regression", REG + ", small AS (SELECT label / 1000 AS label, prediction / 1000 AS prediction FROM preds), w AS (SELECT " + REG_COLS.replace(", 2) AS mse", ", 6) AS mse").replace(", 6)", ", 10)") + " FROM small) SELECT metric, format('{:.4f}', value) AS text FROM (UNPIVOT w ON mse, rmse, mae, r2, explained_variance, max_error, mape, mean_residual, std_residual INTO NAME metric VALUE value)")
def k27(spark, d):
    small = [(F.col(c) / 1000).alias(c) for c in ("label", "prediction")]
    rows = metrics.evaluate_regression(regression_predictions(spark, d).select(*small))
    return metrics.format_metrics(rows.withColumn("value", F.round("value", 10)))


@query("k27_evaluate_classification", PER_CLASS + union_sql([
    "SELECT 'accuracy' AS metric, round(sum(tp) / sum(s), 6) AS value FROM m",
    *[f"SELECT '{x}', round(sum({x} * s) / sum(s), 6) FROM m" for x in metrics.SCORES],
    "SELECT 'mcc', round((sum(tp) * sum(s) - sum(p * s)) / sqrt((sum(s) * sum(s) - sum(p * p)) * (sum(s) * sum(s) - sum(s * s))), 6) FROM m",
    "SELECT 'kappa', round((sum(tp) / sum(s) - sum(p * s) / (sum(s) * sum(s))) / (1 - sum(p * s) / (sum(s) * sum(s))), 6) FROM m",
    "SELECT 'balanced_accuracy', round(avg(recall) FILTER (WHERE s > 0), 6) FROM m",
    "SELECT 'log_loss', round(avg(-ln(CASE label WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END / (w0 + w1 + w2))), 6) FROM preds",
    "SELECT 'roc_auc', round(sum(auc * support) / sum(support), 6) FROM (" + union_sql([AUC_BIN.format(k=f"'{k}'", v=k, s=f"w{k} / (w0 + w1 + w2)") for k in range(3)]) + ")"]))
def k27b(spark, d):
    predictions = class_predictions(spark, d)
    return rounded(metrics.evaluate_classification(predictions, probability="probability").select("metric", "value"))


def one_value(name, sql):
    return f"SELECT '{name}' AS metric, CAST({name} AS DOUBLE) AS value FROM ({sql})"


@query("k27_evaluate_clustering", union_sql([
    one_value("silhouette", silhouette_sql(1, "silhouette")),
    *[one_value(n, ORACLES[k]) for n, k in (("calinski_harabasz", "k23_calinski_harabasz"), ("davies_bouldin", "k24_davies_bouldin"))],
    *[one_value(n, ORACLES["k25_size_variation"]) for n in ("clusters", "size_variation")]]))
def k27c(spark, d):
    rows = clusters.evaluate_clustering(table(spark, d, "embeddings"), "embedding", "label", "vec_id")
    return rounded(rows.select("metric", "value"))


def lines_sql(parts):
    """(kind, position, line) of parts: one line, or (order, line expression, source)."""
    rows = [f"SELECT {i} AS part, 0 AS place, '{p}' AS line" if isinstance(p, str) else f"SELECT {i}, row_number() OVER (ORDER BY {p[0]}), {p[1]} FROM ({p[2]})" for i, p in enumerate(parts)]
    return "SELECT CAST(row_number() OVER (ORDER BY part, place) - 1 AS INTEGER) AS position, line FROM (" + union_sql(rows) + ")"


HEADS = ["accuracy", *metrics.SCORES]
TOLD = "format('{:<12} {:.4f} {:.4f} {:.4f} {}', class, precision, recall, f1, CAST(support AS BIGINT))"
CLASS_ROWS = union_sql([
    "SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, s AS support FROM m",
    "SELECT 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) FROM m",
    "SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) FROM m",
    "SELECT 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) FROM m"])
REG_TEXT = "format('{:<20} {:.4f}', metric, CAST(value AS DOUBLE))"
RESIDUAL = ["mean", "std", "min", "max", "skewness", "kurtosis"]


def named_sql(columns, source):
    return union_sql([f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in columns])


@query("k28_text_reports", "SELECT 'classification' AS kind, * FROM (" + PER_CLASS + lines_sql([
    "Classification report: rule", "",
    ("list_position(" + str(HEADS) + ", metric)", "format('{:<12} {:.4f}', metric, value)",
     union_sql(["SELECT 'accuracy' AS metric, sum(tp) / sum(s) AS value FROM m", *[f"SELECT '{x}', sum({x} * s) / sum(s) FROM m" for x in metrics.SCORES]])),
    "", "class         precision  recall  f1  support", ("TRY_CAST(class AS BIGINT) NULLS LAST, class", TOLD, CLASS_ROWS),
    "", "true → predicted: rows",
    ("label, prediction", "format('{} → {}: {}', label, prediction, n)", "SELECT a.class AS label, b.class AS prediction, coalesce(n, 0) AS n FROM pc a CROSS JOIN pc b LEFT JOIN cm ON cm.label = a.class AND cm.prediction = b.class")])
    + ") UNION ALL SELECT 'regression', * FROM (" + REG + f", w AS (SELECT {REG_COLS.replace(', 2) AS mse', ', 10) AS mse').replace(', 6)', ', 10)')} FROM preds), v AS ({ORACLES['k15_residual_summary'].replace(', 6)', ', 10)')}) " + lines_sql([
    "Regression report: rule", "",
    ("metric", REG_TEXT, named_sql(["mse", "rmse", "mae", "r2", "explained_variance", "max_error", "mape", "mean_residual", "std_residual"], "SELECT * FROM w")),
    "", "Residuals", ("metric", REG_TEXT, named_sql(RESIDUAL, "SELECT * FROM v"))]) + ")")
def k28(spark, d):
    parts = [("classification", reports.classification_lines(class_predictions(spark, d), "rule")),
             ("regression", reports.regression_lines(regression_predictions(spark, d), "rule"))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "position", "line") for kind, df in parts])


def section_sql(section, key, columns, source):
    return union_sql([f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, '{c}' AS name, CAST({c} AS DOUBLE) AS value FROM ({source})" for c in columns])


def class_curve_sql(k):
    return CLS + f""", c AS (SELECT w{k} / (w0 + w1 + w2) AS score, sum(CAST(label = {k} AS INTEGER)) AS pos, sum(CAST(label <> {k} AS INTEGER)) AS neg FROM preds GROUP BY 1),
r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n, pos FROM c WINDOW w AS (ORDER BY score DESC)) """


ROC = union_sql([f"SELECT * FROM ({class_curve_sql(k)} SELECT '{k}' AS class, round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM r UNION ALL SELECT '{k}', NULL, 0, 0)" for k in range(3)])
PRC = union_sql([f"SELECT * FROM ({class_curve_sql(k)} SELECT '{k}' AS class, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM r UNION ALL SELECT '{k}', NULL, 1, 0)" for k in range(3)])


@query("k29_evaluation_bundle", union_sql([
    section_sql("metrics", "metric", ["value"], named_sql(["mse", "rmse", "mae", "r2", "explained_variance", "max_error", "mape", "mean_residual", "std_residual"], ORACLES["k12_regression_metrics"])),
    section_sql("residuals", "metric", ["value"], named_sql(RESIDUAL, ORACLES["k15_residual_summary"])),
    section_sql("residual_histogram", "bin", ["lower", "upper", "n"], ORACLES["k19_residual_histogram"]),
    section_sql("qq", "position", ["residual", "probability", "theoretical"], ORACLES["k18_qq_points"]),
    section_sql("scale_location", "row_id", ["sqrt_abs_standardized"], ORACLES["k19_scale_location"]),
    section_sql("sample", "row_id", ["label", "abs_error", "r2"], ORACLES["k20_prediction_sample"]),
    section_sql("confusion", "label || '/' || prediction", ["value"], f"SELECT * FROM ({ORACLES['k4_confusion_matrix']}) WHERE normalize = 'none'"),
    section_sql("report", "class", ["precision", "recall", "f1", "support"], ORACLES["k3_classification_report"]),
    section_sql("roc", "class", ["threshold", "fpr", "tpr"], ROC),
    section_sql("precision_recall", "class", ["threshold", "precision", "recall"], PRC)]))
def k29(spark, d):
    """All sections, one row for each value."""
    parts = reports.evaluation_bundle(regression_predictions(spark, d), "regression", "row_id")
    parts.update(reports.evaluation_bundle(class_predictions(spark, d), "classification", "row_id", probability="probability"))
    digits = F.when(F.col("metric") == "mse", F.round("value", 2)).otherwise(F.round("value", 6))
    parts["metrics"] = parts["metrics"].withColumn("value", digits)
    parts["residual_histogram"] = rounded(parts["residual_histogram"], 4)
    parts["qq"] = rounded(parts["qq"], 4, ["residual"]).drop("normal")
    parts["scale_location"] = parts["scale_location"].select("row_id", "sqrt_abs_standardized")
    parts["sample"] = parts["sample"].drop("prediction")
    return reports.bundle_rows({k: rounded(v) for k, v in parts.items()}, {"scale_location": ["row_id"], "sample": ["row_id"]})
