"""Training, ensemble and tuning queries (M, N, T, V5) on one derived table.

The table has one row per order that has lines: sums and means over its lines,
a binary and a three-way label, and the charged total as regression target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import ensemble, models, reports, trials, tune
from ...operators.split import train_test_split
from .base import PREDS_CLS_SQL, class_predictions, query, rounded, table, union_sql

FEATURES = ["qty", "price", "n_lines", "disc", "tax"]
KEY = "o_orderkey"

ORDER_SQL = """ord AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) / 1000 AS price, count(*)::DOUBLE AS n_lines, avg(l_discount) AS disc, avg(l_tax) AS tax,
 sum(l_extendedprice * (1 - l_discount)) / 1000 AS charge FROM lineitem GROUP BY 1),
data AS (SELECT *, CASE WHEN charge > 180 THEN 1 ELSE 0 END AS big, CASE WHEN qty < 75 THEN 0 WHEN qty < 125 THEN 1 ELSE 2 END AS size3 FROM ord)"""
SPLIT_SQL = """, parts AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) <= floor(count(*) OVER () * 0.2) AS is_test FROM data)"""


def orders_data(spark, d):
    li = table(spark, d, "lineitem")
    base = li.groupBy(F.col("l_orderkey").alias(KEY)).agg(
        F.sum("l_quantity").alias("qty"),
        (F.sum("l_extendedprice") / 1000).alias("price"),
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("charge"),
    )
    return base.withColumns(
        {
            "big": F.when(F.col("charge") > 180, 1).otherwise(0),
            "size3": F.when(F.col("qty") < 75, 0).when(F.col("qty") < 125, 1).otherwise(2),
        }
    )


def fit_and_score(spark, d, name, label, task, params=None):
    """(metric, value) on the hold-out."""
    train, test = train_test_split(orders_data(spark, d), KEY)
    with models.cached(train) as a, models.cached(test) as b:
        _, _, metrics = models.train(a, b, name, FEATURES, label, task, params, KEY)
    return spark.createDataFrame(sorted(metrics.items()), "metric string, value double")


def register(key, name, label, task, params=None):
    @query(key)
    def run(spark, d):
        return rounded(fit_and_score(spark, d, name, label, task, params), 4)

    return run


register("m1_random_forest_classifier", "random_forest", "size3", "classification")
register("m1_random_forest_regressor", "random_forest", "charge", "regression")
register("m2_gradient_boosting_classifier", "gradient_boosting", "big", "classification")
register("m2_gradient_boosting_multiclass", "gradient_boosting", "size3", "classification")
register("m2_gradient_boosting_regressor", "gradient_boosting", "charge", "regression")
register("m3_logistic_regression", "logistic_regression", "size3", "classification")


@query("m3_logistic_gradient", f"WITH {ORDER_SQL} SELECT DISTINCT size3 AS class, feature, CAST(0 AS DOUBLE) AS gradient FROM data, (SELECT unnest({FEATURES}) AS feature)")
def m3g(spark, d):
    """At the optimum the gradient of the penalised loss is zero, in units of each feature's deviation."""
    data = orders_data(spark, d)
    fitted = models.fit_model(data, "logistic_regression", FEATURES, "size3", "classification")
    found = fitted.transform(data)
    facts = found.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    weights = fitted.model.coefficientMatrix.toArray()
    rows = []
    for k in range(3):
        off = F.col("probability")[k] - (F.col("size3") == k).cast("double")
        for j, c in enumerate(FEATURES):
            mean, spread = facts[f"m_{c}"], facts[f"s_{c}"]
            slope = F.avg(off * (F.col(c) - mean) / spread) + F.lit(float(weights[k, j]) / spread / facts["n"])
            rows.append(F.struct(F.lit(k).alias("class"), F.lit(c).alias("feature"), (F.round(slope, 6) + F.lit(0.0)).alias("gradient")))
    return found.agg(F.array(*rows).alias("r")).select(F.inline("r"))


register("m4_decision_tree_classifier", "decision_tree", "size3", "classification")
register("m4_decision_tree_regressor", "decision_tree", "charge", "regression")
register("m7_linear_svm", "linear_svm", "big", "classification")
register("m7_kernel_svm", "svm", "big", "classification")
register("m7_kernel_svr", "svm", "charge", "regression")
register("m12_huber", "huber", "charge", "regression")
# 100 rounds, the default, take over three minutes here: a fit and three passes each
register("m13_adaboost", "adaboost", "charge", "regression", {"n_estimators": 20})

DIST = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in FEATURES)
NEAR = f"WITH {ORDER_SQL}{SPLIT_SQL}, near AS (SELECT a.o_orderkey, b.size3 AS y, b.charge, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {DIST}, b.o_orderkey) AS r FROM parts a JOIN parts b ON a.is_test AND NOT b.is_test)\n"


def near_query(spark, d, label, task):
    train, test = train_test_split(orders_data(spark, d), KEY)
    model = models.fit_model(train, "knn", FEATURES, label, task, key=KEY)
    return model.transform(test)


SHARES = ", ".join(f"count(*) FILTER (WHERE y = {k}) / 5 AS p{k}" for k in range(3))


@query("m5_knn_probability", NEAR + f"SELECT o_orderkey, {SHARES} FROM near WHERE r <= 5 GROUP BY 1")
def m5p(spark, d):
    out = near_query(spark, d, "size3", "classification")
    return out.select(KEY, *[F.col("probability")[k].alias(f"p{k}") for k in range(3)])


@query("m5_knn_classifier", NEAR + "SELECT o_orderkey, CAST(y AS DOUBLE) AS prediction FROM (SELECT o_orderkey, y, row_number() OVER (PARTITION BY o_orderkey ORDER BY count(*) DESC, y) AS v FROM near WHERE r <= 5 GROUP BY o_orderkey, y) WHERE v = 1")
def m5(spark, d):
    return near_query(spark, d, "size3", "classification").select(KEY, "prediction")


@query("m5_knn_regressor", NEAR + "SELECT o_orderkey, round(avg(charge), 6) AS prediction FROM near WHERE r <= 5 GROUP BY 1")
def m5b(spark, d):
    return rounded(near_query(spark, d, "charge", "regression").select(KEY, "prediction"))


NB = f"WITH {ORDER_SQL}, s AS (SELECT size3, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in FEATURES) + """ FROM data GROUP BY 1),
e AS (SELECT 1e-9 * greatest(""" + ", ".join(f"var_pop({c})" for c in FEATURES) + ") AS eps FROM data), p AS (SELECT o_orderkey, s.size3 AS k, ln(n) " + " ".join(
    f"- 0.5 * ln(2 * pi() * (v_{c} + eps)) - pow({c} - m_{c}, 2) / (2 * (v_{c} + eps))" for c in FEATURES) + """ AS ll FROM data, s, e)
SELECT o_orderkey, CAST(arg_max(k, ll) AS DOUBLE) AS prediction FROM p GROUP BY 1"""


@query("m6_naive_bayes", NB)
def m6(spark, d):
    data = orders_data(spark, d)
    return models.fit_model(data, "naive_bayes", FEATURES, "size3", "classification").transform(data).select(KEY, "prediction")


def one_feature(spark, d, name, params=None):
    model = models.fit_model(orders_data(spark, d), name, ["price"], "charge", "regression", params).model
    return rounded(spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double"), 4)


COV = f"WITH {ORDER_SQL}, c AS (SELECT covar_pop(charge, price) AS c, var_pop(price) AS v, count(*) AS n, avg(charge) AS my, avg(price) AS mx FROM data) "
LINE = "SELECT round(w, 4) AS slope, round(my - w * mx, 4) AS intercept FROM (SELECT *, {w} AS w FROM c)"


@query("m8_linear_regression", f"WITH {ORDER_SQL} SELECT round(regr_slope(charge, price), 4) AS slope, round(regr_intercept(charge, price), 4) AS intercept FROM data")
def m8(spark, d):
    return one_feature(spark, d, "linear_regression")


@query("m9_ridge", COV + LINE.format(w="c / (v + 50000.0 / n)"))
def m9(spark, d):
    return one_feature(spark, d, "ridge", {"alpha": 50000.0})


@query("m10_lasso", COV + LINE.format(w="sign(c) * greatest(abs(c) - 200.0, 0) / v"))
def m10(spark, d):
    return one_feature(spark, d, "lasso", {"alpha": 200.0})


@query("m11_elastic_net", COV + LINE.format(w="sign(c) * greatest(abs(c) - 100.0 * 0.5, 0) / (v + 100.0 * 0.5)"))
def m11(spark, d):
    return one_feature(spark, d, "elastic_net", {"alpha": 100.0, "l1_ratio": 0.5})


@query("m14_train_predict")
def m14(spark, d):
    train, test = train_test_split(orders_data(spark, d), KEY, stratify="size3")
    _, predictions, _ = models.train(train, test, "decision_tree", FEATURES, "size3", "classification")
    return predictions.groupBy("size3", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m15_train_many")
def m15(spark, d):
    train, test = train_test_split(orders_data(spark, d), KEY)
    names = [*models.DEFAULT_REGRESSORS, "no_such_model"]
    _, board = models.train_many(train, test, FEATURES, "charge", "regression", names)
    return board.select("model", F.round(F.col("metrics")["r2"], 4).alias("r2"), "error")


@query("m17_feature_importance")
def m17(spark, d):
    data = orders_data(spark, d)
    parts = []
    for name in ("decision_tree", "linear_regression"):
        model = models.fit_model(data, name, FEATURES, "charge", "regression")
        top = reports.top_importance(models.importance_table(spark, model), 3)
        parts.append(top.select(F.lit(name).alias("model"), "feature", F.round("importance", 4).alias("importance")))
    return reduce(DataFrame.unionByName, parts)


@query("v5_cross_validate")
def v5(spark, d):
    scores = models.cross_validate(orders_data(spark, d), "ridge", FEATURES, "charge", "regression", KEY, metrics=["r2", "mae"])
    return rounded(scores, 4)


@query("k21_learning_curve_fit")
def k21(spark, d):
    train, valid = train_test_split(orders_data(spark, d), KEY)
    return rounded(models.learning_curve(train, valid, "ridge", FEATURES, "charge", "regression", KEY), 4)


LINE = "regr_slope(charge, price) AS a, regr_intercept(charge, price) AS b"
FIT = "round(1 - avg(pow(charge - a * price - b, 2)) / var_pop(charge), 6)"


@query("v5_cross_validate_line", f"""WITH {ORDER_SQL}, f AS (SELECT *, CAST(((row_number() OVER (ORDER BY md5('42:' || o_orderkey)) - 1) * 5) // count(*) OVER () AS INTEGER) AS fold FROM data),
k AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS k), fits AS (SELECT k, {LINE} FROM f JOIN k ON fold <> k GROUP BY k)
SELECT fold, 'r2' AS metric, {FIT} AS value FROM f JOIN fits ON fold = k GROUP BY fold
UNION ALL SELECT fold, 'mae', round(avg(abs(charge - a * price - b)), 6) FROM f JOIN fits ON fold = k GROUP BY fold""")
def v5b(spark, d):
    """A line in each fold has a closed form."""
    return rounded(models.cross_validate(orders_data(spark, d), "linear_regression", ["price"], "charge", "regression", KEY, metrics=["r2", "mae"]))


@query("k21_learning_curve_line", f"WITH {ORDER_SQL}{SPLIT_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || o_orderkey)) AS rn, count(*) OVER () AS n FROM parts WHERE NOT is_test) " + union_sql([
    f"""SELECT CAST({s} AS DOUBLE) AS size, 0 AS fold, (SELECT {FIT} FROM t WHERE rn <= floor(n * {s})) AS train_score, (SELECT {FIT} FROM parts WHERE is_test) AS valid_score
    FROM (SELECT {LINE} FROM t WHERE rn <= floor(n * {s}))""" for s in (0.1, 0.25, 0.5, 1.0)]))
def k21b(spark, d):
    train, valid = train_test_split(orders_data(spark, d), KEY)
    return rounded(models.learning_curve(train, valid, "linear_regression", ["price"], "charge", "regression", KEY))


# ---- ensembles ------------------------------------------------------------------

VOTES_SQL = f"""WITH {PREDS_CLS_SQL}, v AS (SELECT label, [w0, w1, w2] AS a, [w0 * 0.5, w1, w2 * 1.5] AS b, [w1, w2, w0] AS c FROM preds),
n AS (SELECT label, list_transform(a, lambda x: x / list_sum(a)) AS a, list_transform(b, lambda x: x / list_sum(b)) AS b, list_transform(c, lambda x: x / list_sum(c)) AS c FROM v),
"""


def ballots(spark, d):
    p = F.col("probability")

    def norm(parts):
        total = parts[0] + parts[1] + parts[2]
        return F.array(*[x / total for x in parts])

    return class_predictions(spark, d).select(
        "label",
        norm([p[0], p[1], p[2]]).alias("a"),
        norm([p[0] * 0.5, p[1], p[2] * 1.5]).alias("b"),
        norm([p[1], p[2], p[0]]).alias("c"),
    )


@query("n1_soft_voting", VOTES_SQL + """m AS (SELECT label, list_transform(range(3), lambda i: round((2 * a[i + 1] + b[i + 1] + c[i + 1]) / 4, 9)) AS p FROM n)
SELECT label, CAST(list_position(p, list_max(p)) - 1 AS DOUBLE) AS prediction, count(*) AS n FROM m GROUP BY ALL""")
def n1(spark, d):
    mixed = ballots(spark, d).withColumn("p", F.transform(ensemble.soft_vote(["a", "b", "c"], [2, 1, 1]), lambda x: F.round(x, 9)))
    return mixed.groupBy("label", ensemble.top_class(F.col("p")).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("n1_hard_voting", """WITH l AS (SELECT l_linenumber % 3 AS a, l_suppkey % 3 AS b, l_partkey % 3 AS c FROM lineitem),
v AS (SELECT a, b, c, list_transform(range(3), lambda k: CASE WHEN a = k THEN 1.0 ELSE 0 END + CASE WHEN b = k THEN 1.5 ELSE 0 END + CASE WHEN c = k THEN 1.0 ELSE 0 END) AS s FROM l)
SELECT a, b, c, CAST(list_position(s, list_max(s)) - 1 AS DOUBLE) AS prediction, count(*) AS n FROM v GROUP BY ALL""")
def n1b(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_partkey") % 3).alias("c"))
    vote = ensemble.hard_vote(["a", "b", "c"], [1.0, 1.5, 1.0])
    return li.groupBy("a", "b", "c", vote.alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("n1_mean_voting", "SELECT l_orderkey, l_linenumber, round((2 * l_quantity + l_tax + l_discount) / 4, 6) AS prediction FROM lineitem")
def n1c(spark, d):
    vote = ensemble.mean_vote(["l_quantity", "l_tax", "l_discount"], [2, 1, 1])
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", vote.alias("prediction")))


BASES = [("tree", "decision_tree", {}), ("line", "logistic_regression", {})]
REG_BASES = [("tree", "decision_tree", {}), ("line", "ridge", {})]


def ensemble_query(spark, d, build, label, task):
    train, test = train_test_split(orders_data(spark, d), KEY)
    with models.cached(train) as a:
        model = build(a)
        metrics = models.all_scores(model.transform(test), label, task)
    return rounded(spark.createDataFrame(sorted(metrics.items()), "metric string, value double"), 4)


@query("n2_stacking")
def n2(spark, d):
    return ensemble_query(spark, d, lambda a: ensemble.fit_stacking(a, REG_BASES, FEATURES, "charge", "regression", KEY, folds=5, passthrough=True), "charge", "regression")


@query("n2_stacking_classifier")
def n2b(spark, d):
    return ensemble_query(spark, d, lambda a: ensemble.fit_stacking(a, BASES, FEATURES, "big", "classification", KEY), "big", "classification")


@query("n3_blending")
def n3(spark, d):
    return ensemble_query(spark, d, lambda a: ensemble.fit_blending(a, BASES, FEATURES, "size3", "classification", KEY), "size3", "classification")


@query("n4_multi_level")
def n4(spark, d):
    return ensemble_query(spark, d, lambda a: ensemble.fit_multi_level(a, [REG_BASES, [("line", "ridge", {})]], FEATURES, "charge", "regression", KEY), "charge", "regression")


@query("n5_compare_all", "SELECT 'Base_' || model AS model, round(value, 6) AS value FROM (SELECT o_orderpriority AS model, avg(o_totalprice) / 500000 AS value FROM orders GROUP BY 1) UNION ALL SELECT 'Ensemble_' || model, round(value, 6) FROM (SELECT o_orderstatus AS model, avg(o_totalprice) / 400000 AS value FROM orders GROUP BY 1)")
def n5(spark, d):
    orders = table(spark, d, "orders")

    def board(column, scale):
        return orders.groupBy(F.col(column).alias("model")).agg(F.create_map(F.lit("r2"), F.avg("o_totalprice") / scale).alias("metrics"))

    return rounded(ensemble.compare_all(board("o_orderpriority", 500000), board("o_orderstatus", 400000), "r2"))


@query("n6_auto_ensemble")
def n6(spark, d):
    train, test = train_test_split(orders_data(spark, d), KEY)
    _, board = ensemble.auto_ensemble(train, test, REG_BASES, FEATURES, "charge", "regression", KEY)
    return rounded(board, 4)


# ---- tuning ---------------------------------------------------------------------

SPACE = {
    "max_depth": tune.Param("int", 2, 6),
    "min_samples_leaf": tune.Param("int", 1, 64, log=True),
}

TRIALS_SQL = """WITH trials AS (SELECT p_partkey AS trial, p_retailprice AS value, p_size AS size, CASE WHEN p_partkey % 6 = 0 THEN 'PRUNED' ELSE 'COMPLETE' END AS state, p_brand AS brand FROM part)
"""


def part_trials(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("trial"),
        F.col("p_retailprice").alias("value"),
        F.col("p_size").alias("size"),
        F.when(k % 6 == 0, "PRUNED").otherwise("COMPLETE").alias("state"),
        F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")).alias("params"),
    )


@query("t1_trial_points")
def t1(spark, d):
    space = {**SPACE, "kind": tune.Param("categorical", choices=("a", "b")), "rate": tune.Param("float", 0.01, 1.0, log=True, when=("kind", "a"))}
    n = table(spark, d, "region").count()
    rows = []
    for method in ("random", "lhs", "grid"):
        rows += [(method, i, {k: str(v) for k, v in p.items()}) for i, p in enumerate(tune.sample_points(space, n * 4, method))]
    points = spark.createDataFrame(rows, "method string, trial int, params map<string,string>")
    return points.select("method", "trial", *[F.col("params")[p].alias(p) for p in ("max_depth", "min_samples_leaf", "kind", "rate")])


@query("t2_evaluate_trials")
def t2(spark, d):
    data = orders_data(spark, d)
    with models.cached(data) as ready:
        objective = tune.model_objective(ready, "decision_tree", FEATURES, "charge", "regression", KEY, "r2", folds=3)
        study = tune.Study(SPACE).run(objective, 3)
    return study.frame(spark).select("trial", "state", F.round("value", 4).alias("value"))


@query("t3_run_study")
def t3(spark, d):
    train, valid = train_test_split(orders_data(spark, d), KEY)
    study, model = tune.tune_model(train, "decision_tree", FEATURES, "charge", "regression", KEY, SPACE, n_trials=3, metric="mae", valid=valid)
    study, model = tune.tune_model(train, "decision_tree", FEATURES, "charge", "regression", KEY, SPACE, n_trials=2, metric="mae", valid=valid, study=study)
    best = trials.best_trial(study.frame(spark), study.direction)
    return best.select("trial", F.round("value", 4).alias("value"), "state")


@query("t4_history", TRIALS_SQL + "SELECT trial, value, size, state, CAST(size AS VARCHAR) AS param_size, brand AS param_brand FROM trials")
def t4(spark, d):
    return trials.history(part_trials(spark, d), ["size", "brand"])


@query("t5_best_so_far", TRIALS_SQL + "SELECT trial, value, max(value) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best FROM trials WHERE state = 'COMPLETE'")
def t5(spark, d):
    return trials.best_so_far(part_trials(spark, d))


@query("t6_param_ranges", TRIALS_SQL + "SELECT 'size' AS param, min(size)::DOUBLE AS low, max(size)::DOUBLE AS high, (max(size) - min(size))::DOUBLE AS range, count(*) AS n FROM trials")
def t6(spark, d):
    return trials.param_ranges(part_trials(spark, d))


@query("t6_parallel_coordinates", TRIALS_SQL + "SELECT trial, value, 'size' AS param, CAST(size AS VARCHAR) AS text FROM trials WHERE state = 'COMPLETE' UNION ALL SELECT trial, value, 'brand', brand FROM trials WHERE state = 'COMPLETE'")
def t6b(spark, d):
    return trials.parallel_coordinates(part_trials(spark, d))


@query("t7_median_rule", TRIALS_SQL + ", s AS (SELECT CAST(size % 4 AS INTEGER) AS round, trial, value FROM trials), m AS (SELECT round, quantile_cont(value, 0.5) AS median FROM s GROUP BY 1) SELECT s.round, trial, value, round(median, 6) AS median, value >= median AS keep FROM s JOIN m ON s.round = m.round")
def t7(spark, d):
    s = part_trials(spark, d).select((F.col("size") % 4).cast("int").alias("round"), "trial", "value")
    return rounded(trials.prune_below_median(s), 6, ["median"])


@query("t7_successive_halving")
def t7b(spark, d):
    done, _ = tune.successive_halving(orders_data(spark, d), "decision_tree", FEATURES, "charge", "regression", KEY, SPACE, n_trials=4, shares=(0.5, 1.0))
    return done.select("trial", "state", F.round("value", 4).alias("value"))


@query("t8_study_summary", TRIALS_SQL + """SELECT count(*) AS trials, count(*) FILTER (WHERE state = 'COMPLETE') AS complete, count(*) FILTER (WHERE state = 'PRUNED') AS pruned, count(*) FILTER (WHERE state = 'FAIL') AS failed,
(SELECT trial FROM trials WHERE state = 'COMPLETE' ORDER BY value DESC, trial LIMIT 1) AS best_trial, (SELECT max(value) FROM trials WHERE state = 'COMPLETE') AS best_value,
round(100 * ((SELECT max(value) FROM trials WHERE state = 'COMPLETE') - (SELECT value FROM trials WHERE state = 'COMPLETE' ORDER BY trial LIMIT 1)) / abs((SELECT value FROM trials WHERE state = 'COMPLETE' ORDER BY trial LIMIT 1)), 6) AS improvement_pct FROM trials""")
def t8(spark, d):
    return rounded(trials.study_summary(part_trials(spark, d)), 6, ["improvement_pct"])


@query("t9_pareto_front", TRIALS_SQL + ", c AS (SELECT * FROM trials WHERE state = 'COMPLETE') SELECT trial, value, size FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.value >= a.value AND b.size <= a.size AND (b.value > a.value OR b.size < a.size))")
def t9(spark, d):
    front = trials.pareto_front(part_trials(spark, d), {"value": "maximize", "size": "minimize"})
    return front.select("trial", "value", "size")


@query("t9_pareto_front_three", TRIALS_SQL + ", c AS (SELECT *, trial % 97 AS cost FROM trials WHERE state = 'COMPLETE') SELECT trial, value, size, cost FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.value >= a.value AND b.size <= a.size AND b.cost <= a.cost AND (b.value > a.value OR b.size < a.size OR b.cost < a.cost))")
def t9b(spark, d):
    df = part_trials(spark, d).withColumn("cost", F.col("trial") % 97)
    return trials.pareto_front(df, {"value": "maximize", "size": "minimize", "cost": "minimize"}).select("trial", "value", "size", "cost")


@query("t9_many_objectives")
def t9c(spark, d):
    _, front = tune.tune_many_objectives(orders_data(spark, d), "decision_tree", FEATURES, "charge", "regression", KEY, SPACE, ["r2", "max_error"], n_trials=4)
    return front.select("trial", F.round("r2", 4).alias("r2"), F.round("max_error", 4).alias("max_error"))
