"""Models against closed forms, ensembles and tuning on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ensemble, logistic, metrics, models, tune
from millrace.operators.split import train_test_split

X = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 2)) * [1.0, 3.0]
    y = 2.0 + 1.5 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=240) * 0.3
    c = (y + rng.normal(size=240) > 2).astype(int)
    rows = [(i, float(p), float(r), float(t), int(k)) for i, ((p, r), t, k) in enumerate(zip(x, y, c))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, c int").cache()
    return df, x, y, c


def test_linear_family(data):
    df, x, y, _ = data
    xc, yc, n = x - x.mean(axis=0), y - y.mean(), len(y)

    def fitted(name, **p):
        return models.fit_model(df, name, X, "y", "regression", p).model.coefficients.toArray()

    ols = np.linalg.lstsq(xc, yc, rcond=None)[0]
    assert np.allclose(fitted("linear_regression"), ols, atol=1e-6)
    ridge = np.linalg.solve(xc.T @ xc + 50 * np.eye(2), xc.T @ yc)
    assert np.allclose(fitted("ridge", alpha=50.0), ridge, atol=1e-5)

    def elastic(alpha, ratio):
        w = np.zeros(2)
        for _ in range(500):
            for j in range(2):
                r = yc - xc @ w + xc[:, j] * w[j]
                g = xc[:, j] @ r / n
                w[j] = math.copysign(max(abs(g) - alpha * ratio, 0), g) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
        return w

    assert np.allclose(fitted("lasso", alpha=0.3), elastic(0.3, 1.0), atol=1e-4)
    assert np.allclose(fitted("elastic_net", alpha=0.4, l1_ratio=0.3), elastic(0.4, 0.3), atol=1e-4)


def test_huber_resists_outliers(spark, data):
    df, x, y, _ = data
    bent = df.withColumn("y", F.when(F.col("id") % 20 == 0, F.col("y") + 200).otherwise(F.col("y")))
    w = models.fit_model(bent, "huber", X, "y", "regression").model
    assert np.allclose(w.coefficients.toArray(), [1.5, -0.5], atol=0.1) and abs(w.intercept - 2.0) < 0.3


def test_logistic_regression_penalty(data):
    df, x, _, c = data
    m = models.fit_model(df, "logistic_regression", X, "c", "classification", {"C": 0.5}).model
    w = np.zeros(3)
    a = np.column_stack([np.ones(len(x)), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        pen = np.diag([0, 1 / 0.5, 1 / 0.5])
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a + pen, a.T @ (p - c) + pen @ w)
    assert np.allclose([m.intercept, *m.coefficients.toArray()], w, atol=5e-3)


@pytest.mark.parametrize("classes", [2, 4])
def test_newton_steps_agree_with_the_iterative_solver(spark, classes):
    """Few passes, features of very different sizes, probabilities equal to 1e-6."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(600, 3)) * [1.0, 300.0, 0.01] + [0, 5000.0, 0]
    y = (x @ [1.0, 0.004, 60.0] - 20 + rng.normal(size=600)).argsort().argsort() * classes // 600
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, e double, y int")
    fitted = models.fit_model(df, "logistic_regression", ["a", "b", "e"], "y", "classification", {"C": 2.0})
    assert fitted.model.passes < 15 and fitted.model.gradient < 1e-9
    solver = models.classifier("logistic_regression", "y", 600, classes, {"C": 2.0, "tol": 1e-13, "max_iter": 5000})
    theirs = models.FittedModel("x", "classification", ["a", "b", "e"], solver.fit(models.assemble(df, ["a", "b", "e"])))
    ours, want = (np.array([r["probability"] for r in m.transform(df).orderBy("id").collect()]) for m in (fitted, theirs))
    assert np.abs(ours - want).max() < 1e-5
    # the gradient of the penalised loss, from the predictions
    kept = x * 1.0
    target = np.eye(classes)[y]
    w = fitted.model.coefficientMatrix.toArray() if classes > 2 else np.vstack([-fitted.model.coefficients.toArray(), fitted.model.coefficients.toArray()])
    gradient = ((ours - target).T @ kept / 600 + w / (2.0 * 600)) / kept.std(axis=0)
    if classes == 2:
        gradient = gradient[1:]
    assert np.abs(gradient - (ours - target).mean(axis=0)[-len(gradient):, None] * (kept.mean(axis=0) / kept.std(axis=0))).max() < 1e-6


def test_user_metrics(data):
    df = data[0]

    def share_right(predictions):
        return predictions.agg(F.avg((F.col("c") == F.col("prediction")).cast("double"))).first()[0]

    rows = models.cross_validate(df, "decision_tree", X, "c", "classification", "id", folds=2, metrics=["accuracy", share_right])
    got = {(r["fold"], r["metric"]): r["value"] for r in rows.collect()}
    assert all(got[f, "accuracy"] == got[f, "share_right"] for f in (0, 1))
    lower = metrics.scorer(lambda p: p.agg(F.avg(F.abs(F.col("y") - F.col("prediction")))), greater_is_better=False)
    _, _, scores = models.train(df, df, "linear_regression", X, "y", "regression", metrics=[lower])
    assert scores[models.metric_name(lower)] == -scores["mae"]
    study, _ = tune.tune_model(df, "decision_tree", X, "c", "classification", "id", {"max_depth": tune.Param("int", 1, 3)}, n_trials=2, metric=share_right, folds=2)
    assert study.direction == "maximize" and all(0 < r[2] <= 1 for r in study.frame(df.sparkSession).select("trial", "state", "value").collect())


def known(name, params):
    """Only parameters of the model: others are errors (see below)."""
    return {k: v for k, v in params.items() if k in models.PARAMS[name]}


def test_unknown_parameters_are_errors(data):
    with pytest.raises(ValueError, match="max_dept"):
        models.fit_model(data[0], "decision_tree", X, "c", "classification", {"max_dept": 3})


@pytest.mark.parametrize(
    "name, params, set_",
    [
        ("random_forest", {"max_features": "log2"}, "featureSubsetStrategy"),
        ("random_forest", {"criterion": "entropy"}, "impurity"),
        ("random_forest", {"bootstrap": False}, "bootstrap"),
        ("random_forest", {"max_samples": 0.5}, "subsamplingRate"),
        ("decision_tree", {"min_impurity_decrease": 0.1}, "minInfoGain"),
        ("decision_tree", {"max_bins": 8}, "maxBins"),
        ("gradient_boosting", {"subsample": 0.5}, "subsamplingRate"),
        ("gradient_boosting", {"learning_rate": 0.3}, "stepSize"),
        ("logistic_regression", {"penalty": "l1"}, "elasticNetParam"),
        ("logistic_regression", {"C": 5.0}, "regParam"),
        ("linear_svm", {"tol": 0.1}, "tol"),
    ],
)
def test_parameters_reach_the_estimator(data, name, params, set_):
    plain, given = (models.classifier(name, "c", 100, 2, p) for p in ({}, params))
    assert plain.getOrDefault(set_) != given.getOrDefault(set_)


def test_support_vectors_ignore_what_is_inside_the_tube(spark):
    rows = [(float(i), 2.0 * i + 1 + (0.4 if i % 2 else -0.4)) for i in range(60)] + [(30.0, 500.0)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = models.fit_model(df, "linear_svr", ["a"], "y", "regression", {"epsilon": 0.5, "C": 10.0})
    assert abs(model.weights[0] - 2.0) < 0.05 and abs(model.intercept - 1.0) < 1.0


def test_kernel_regression_keeps_raw_features(data, monkeypatch):
    """The lifted features, a hundred numbers a row, are made in the passes and never kept."""
    kept = []
    real = models.cached
    monkeypatch.setattr(models, "cached", lambda df: kept.append(df) or real(df))
    params = {"components": 60, "max_iter": 5}
    model = models.fit_model(data[0], "svm", X, "y", "regression", params)
    assert len(kept) == 1 and len(kept[0].first()["x"]) == len(X) and len(model.weights) == 60


def test_newton_tries_one_step_at_a_time(data, monkeypatch):
    tries = []
    real = logistic._pass
    monkeypatch.setattr(logistic, "_pass", lambda *a: tries.append(len(a[-1])) or real(*a))
    model = models.fit_model(data[0], "logistic_regression", X, "c", "classification").model
    assert model.gradient < 1e-9 and sum(tries) < 3 * len(tries)


@pytest.mark.parametrize("name", models.CLASSIFIERS)
def test_classifiers_learn(data, name):
    df = data[0]
    small = {"n_estimators": 5, "components": 30, "max_iter": 30}
    model = models.fit_model(df, name, X, "c", "classification", known(name, small), key="id")
    out = model.transform(df)
    assert models.score(out, "c", "accuracy") > 0.7
    assert out.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-6).isEmpty()


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting", "svm", "decision_tree", "knn", "adaboost"])
def test_regressors_learn(data, name):
    df = data[0]
    model = models.fit_model(df, name, X, "y", "regression", known(name, {"n_estimators": 6, "components": 60, "max_iter": 50, "learning_rate": 0.5}), key="id")
    assert models.score(model.transform(df), "y", "r2") > 0.6


def test_adaboost_predicts_the_weighted_median(spark):
    class Constant:
        """Stands in for a tree that predicts one value."""

        def __init__(self, v, col="prediction"):
            self.v, self.predictionCol, self.col = v, "p", col

        def copy(self, extra):
            return Constant(self.v, next(iter(extra.values())))

        def transform(self, df):
            return df.withColumn(self.col, F.lit(self.v))

    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    boosted = models.BoostedTrees("adaboost", "regression", X, [Constant(5.0), Constant(1.0), Constant(3.0)], [1.0, 1.0, 5.0])
    assert boosted.transform(df).first()["prediction"] == 3.0


def test_train_many_isolates_failures(data):
    df = data[0]
    train, test = train_test_split(df, "id")
    fitted, board = models.train_many(train, test, X, "y", "regression", ["ridge", "nope", "decision_tree"])
    rows = {r["model"]: r for r in board.collect()}
    assert set(fitted) == {"ridge", "decision_tree"} and "nope" in rows["nope"]["error"]
    assert models.best_model(board, "r2").first()["model"] == "ridge"
    assert models.best_model(board, "mae", minimize=True).first()["model"] == "ridge"


def test_cross_validation_scores(data):
    rows = models.cross_validate(data[0], "ridge", X, "y", "regression", "id", folds=4, metrics=["r2", "mae"]).collect()
    assert len(rows) == 8 and all(r["value"] > 0.9 for r in rows if r["metric"] == "r2")


def test_ensembles(data):
    df = data[0]
    train, test = train_test_split(df, "id")
    bases = [("line", "ridge", {}), ("tree", "decision_tree", {})]
    voting = ensemble.fit_voting(train, bases, X, "y", "regression", weights=[3, 1])
    stack = ensemble.fit_stacking(train, bases, X, "y", "regression", "id", folds=3)
    deep = ensemble.fit_multi_level(train, [bases, [("line", "ridge", {})]], X, "y", "regression", "id", folds=3)
    for m in (voting, stack, deep):
        assert models.score(m.transform(test), "y", "r2") > 0.85
    kinds = [("line", "logistic_regression", {"max_iter": 30}), ("tree", "decision_tree", {})]
    blend = ensemble.fit_blending(train, kinds, X, "c", "classification", "id")
    out = blend.transform(test)
    assert out.columns == [*test.columns, "prediction", "probability"]
    assert models.score(out, "c", "accuracy") > 0.65
    hard = ensemble.fit_voting(train, kinds, X, "c", "classification", voting="hard")
    assert models.score(hard.transform(test), "c", "accuracy") > 0.65


def test_out_of_fold_rows_are_unseen(data):
    df = data[0]
    rows = ensemble.out_of_fold(df, [("knn", "knn", {"n_neighbors": 1})], X, "y", "regression", "id", folds=3)
    # a seen row would be its own nearest neighbour
    assert rows.count() == df.count() and rows.where(F.col("_p_knn") == F.col("y")).isEmpty()


def test_sampling_respects_the_space():
    space = {
        "depth": tune.Param("int", 2, 8, step=2),
        "rate": tune.Param("float", 1e-3, 1.0, log=True),
        "kind": tune.Param("categorical", choices=("x", "y")),
        "only_x": tune.Param("float", 0, 1, when=("kind", "x")),
    }
    for method in ("random", "lhs"):
        points = tune.sample_points(space, 40, method, seed=3)
        assert len(points) == 40 and points == tune.sample_points(space, 40, method, seed=3)
        for p in points:
            assert p["depth"] in (2, 4, 6, 8) and 1e-3 <= p["rate"] <= 1
            assert ("only_x" in p) == (p["kind"] == "x")
    more = tune.sample_points(space, 10, "random", seed=3, skip=40)
    assert more == tune.sample_points(space, 50, "random", seed=3)[40:]
    grid = tune.sample_points(space, 10_000, "grid", levels=3)
    assert len(grid) == len({tuple(sorted(p.items())) for p in grid})
    lhs = sorted(p["u"] for p in tune.sample_points({"u": tune.Param("float", 0, 1)}, 10, "lhs"))
    assert [int(v * 10) for v in lhs] == list(range(10))
    with pytest.raises(ValueError):
        tune.sample_points(space, 1, "nope")


def test_study_records_failures_and_continues(spark):
    def objective(p):
        if p["x"] > 0.8:
            raise RuntimeError("no model")
        return (p["x"] - 0.3) ** 2

    study = tune.Study({"x": tune.Param("float", 0, 1)}, "minimize")
    study.run(objective, 20).run(objective, 20)
    frame = study.frame(spark)
    assert frame.count() == 40 and study.best[1] < 0.01
    assert frame.where("state = 'FAIL'").count() == sum(p["x"] > 0.8 for p in study.points.values())
    assert tune.Study(study.space).run(objective, 5, timeout=-1.0).rows == []


def test_successive_halving_keeps_the_better_half(data):
    space = {"max_depth": tune.Param("int", 1, 6)}
    trials, scores = tune.successive_halving(data[0], "decision_tree", X, "y", "regression", "id", space, n_trials=4, shares=(0.5, 1.0))
    states = [r["state"] for r in trials.collect()]
    assert states.count("COMPLETE") >= 2 and scores.where("round = 1").count() == states.count("COMPLETE")


@pytest.mark.parametrize("name, task", [("decision_tree", "classification"), ("svm", "regression"), ("knn", "classification"), ("ridge", "regression")])
def test_saved_models_predict_the_same(spark, data, tmp_path, name, task):
    from millrace.sources import store

    df, label = data[0], "c" if task == "classification" else "y"
    model = models.fit_model(df, name, X, label, task, known(name, {"components": 20, "max_iter": 5}), key="id")
    store.save_fitted(spark, model, str(tmp_path / "m"))
    again = store.load_fitted(spark, str(tmp_path / "m"))
    assert type(again) is type(model)
    want, got = (sorted(map(tuple, m.transform(df).select("id", "prediction").collect())) for m in (model, again))
    assert got == want
