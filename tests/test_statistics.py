"""Closed-form and brute-force checks of statistics and joins."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.normal import normal_quantile
from millrace.operators import (
    association,
    clusters,
    curves,
    eventlog,
    features,
    isolation,
    metrics,
    neighbors,
    residuals,
    scale,
    trials,
)
from millrace.operators.impute import impute_iterative, impute_knn


def test_normal_quantile(spark):
    ps = [1e-7, 1e-4, 0.02, 0.1, 0.5, 0.7, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-7, atol=1e-8)


def ranks(x):
    order = np.argsort(x, kind="stable")
    r = np.empty(len(x))
    r[order] = np.arange(1, len(x) + 1)
    return np.array([r[x == v].mean() for v in x])


def tau_b(x, y):
    c = d = tx = ty = 0
    for (a, b), (e, f) in combinations(list(zip(x, y)), 2):
        s = np.sign(a - e) * np.sign(b - f)
        c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a == e), ty + (b == f)
    n0 = len(x) * (len(x) - 1) / 2
    return (c - d) / math.sqrt((n0 - tx) * (n0 - ty))


def test_rank_correlations_in_buckets(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 40, size=200).astype(float)
    y = np.round(x / 4 + rng.normal(size=200) * 3)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "a double, b double")
    assert association.spearman(df, "a", "b", bucket_rows=8).first()["r"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert association.kendall(df, "a", "b", bucket_rows=8).first()["r"] == pytest.approx(tau_b(x, y))


def brute_distance(a, b, p):
    known = ~np.isnan(a) & ~np.isnan(b)
    if not known.any():
        return math.inf
    d = (np.abs(a[known] - b[known]) ** p).sum() * len(a) / known.sum()
    return d ** (1 / p)


@pytest.mark.parametrize("p,holes", [(2, 0.0), (2, 0.3), (1, 0.0)])
def test_nearest_rows_with_many_cells_and_chunks(spark, p, holes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    x[:150] = x[0]  # one hot group of equal rows
    x[rng.uniform(size=x.shape) < holes] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    ask = df.where("id % 8 = 0")
    got = neighbors.nearest_rows(ask, df, ["a", "b", "c"], "id", "id", 4, p=p, cell_rows=20, chunk_rows=30)
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["neighbor_id"], r["distance"]))
    for i in range(0, 400, 8):
        d = [(round(brute_distance(x[i], x[j], p), 9), j) for j in range(400)]
        want = [(j, v) for v, j in sorted(t for t in d if t[0] < math.inf)[:4]]
        got_i = [(j, round(v, 9)) for j, v in found.get(i, [])]
        assert got_i == want


@pytest.mark.parametrize("p", [1, 2])
def test_nearest_rows_in_many_dimensions(spark, p):
    """64 dimensions, where boxes hold nearly every query; ids are texts; few cells are visited."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(30, size=1500)] + 0.25 * rng.normal(size=(1500, 64))
    x[700:900] = x[700]  # equal rows
    names = [f"f{j}" for j in range(64)]
    rows = [(f"row {i:04d}", *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", *names])
    report: dict = {}
    got = neighbors.nearest_rows(df, df, names, "id", "id", 5, p=p, cell_rows=50, chunk_rows=60, report=report)
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["neighbor_id"], round(r["distance"], 9)))
    for i in range(0, 1500, 25):
        d = np.abs(x[i] - x).sum(axis=1) if p == 1 else np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        want = sorted((round(v, 9), rows[j][0]) for j, v in enumerate(d))[:5]
        assert found[rows[i][0]] == [(j, v) for v, j in want]
    assert report["cells"] > 15 and report["visited"] < (0.8 if p == 1 else 0.6)


def test_visits_of_a_query_do_not_grow_with_the_table(spark):
    """Cells follow the rows and the own leaf bounds the search: a query compares about as many rows at any size."""
    visits = {}
    for n in (2_000, 16_000):
        df = spark.range(n).select(
            "id", *[F.rand(seed=i).alias(c) for i, c in enumerate("ab")], F.when(F.col("id") % 9 != 0, F.rand(seed=7)).alias("c"))
        report: dict = {}
        got = neighbors.nearest_rows(df.where("id % 20 = 0"), df, ["a", "b", "c"], "id", "id", 3, cell_rows=50, report=report)
        assert got.where("rank = 1 and query_id <> neighbor_id").isEmpty()
        assert report["cells"] >= n / 50
        visits[n] = report["visited"] * report["cells"]
    assert visits[16_000] < 1.6 * visits[2_000]


def test_silhouette_over_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(60, 2)), rng.normal(size=(30, 2)) + 4, [[9.0, 9.0]]])
    c = [0] * 60 + [1] * 30 + [2]
    df = spark.createDataFrame([(i, r.tolist(), k) for i, (r, k) in enumerate(zip(x, c))], "id long, f array<double>, k int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    c = np.array(c)
    want = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        if own == 1:
            want.append(0.0)
            continue
        a = d[i, c == c[i]].sum() / (own - 1)
        b = min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        want.append((b - a) / max(a, b))
    got = clusters.silhouette(df, "f", "k", "id", block_rows=25).orderBy("row_id").collect()
    assert np.allclose([r["silhouette"] for r in got], want)
    assert clusters.silhouette(df.where("k = 0"), "f", "k", "id").count() == 0


def test_curves_in_buckets(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, size=500)
    s = np.round(rng.uniform(size=500) + y * 0.3, 2)
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")
    points = curves.score_counts(df, "label", "score", bucket_rows=10)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert curves.class_auc(points).first()["auc"] == pytest.approx(want)
    for r in points.collect():
        assert (r["tp"], r["fp"]) == ((pos >= r["threshold"]).sum(), (neg >= r["threshold"]).sum())
    one_class = curves.score_counts(df.where("label = 1"), "label", "score")
    assert curves.class_auc(one_class).first()["auc"] is None


def test_residuals_in_buckets(spark):
    rng = np.random.default_rng(8)
    e = np.round(rng.normal(size=300), 1)
    df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(e)], "id long, label double, prediction double")
    got = residuals.durbin_watson(df, "id", bucket_rows=20).first()[0]
    assert got == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    qq = residuals.qq_points(df, bucket_rows=20).orderBy("position").collect()
    assert [r["residual"] for r in qq] == sorted(e.tolist())
    assert [r["position"] for r in qq] == list(range(300))


def test_power_transforms_find_the_likelihood_peak(spark):
    rng = np.random.default_rng(9)
    x = np.exp(rng.normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")

    def best(fn, jac):
        grid = np.linspace(-2, 2, 4001)
        ll = [-len(x) / 2 * np.log(np.var(fn(lam))) + (lam - 1) * jac for lam in grid]
        return grid[int(np.argmax(ll))]

    def box(lam):
        return np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam

    def yeo(lam):
        return np.log1p(x) if abs(lam) < 1e-12 else ((x + 1) ** lam - 1) / lam

    assert scale.fit_lambda(df, ["x"], "box")["x"] == pytest.approx(best(box, np.log(x).sum()), abs=2e-3)
    assert scale.fit_lambda(df, ["x"], "yeo")["x"] == pytest.approx(best(yeo, np.log1p(x).sum()), abs=2e-3)


def test_distribution_tests(spark):
    rng = np.random.default_rng(10)
    rows = list(zip(rng.normal(size=400).tolist(), rng.uniform(size=400).tolist(), (rng.exponential(size=400)).tolist()))
    df = spark.createDataFrame(rows, "n double, u double, e double")
    assert scale.distribution_tests(df, ["n", "u", "e"]) == {"n": "normal", "u": "uniform", "e": "other"}
    assert scale.distribution_tests(df.limit(5), ["n"]) == {"n": "unknown"}
    assert scale.kolmogorov_p(1.36 / math.sqrt(1000), 1000) == pytest.approx(0.05, abs=2e-3)


def test_iterative_imputation_recovers_a_plane(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 2))
    z = 1 + 2 * x[:, 0] - x[:, 1]
    rows = [(i, float(a), float(b), None if i % 5 == 0 else float(c)) for i, (a, b, c) in enumerate(zip(*x.T, z))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: r["c"] for r in impute_iterative(df, ["a", "b", "c"]).collect()}
    assert all(got[i] == pytest.approx(z[i], abs=1e-3) for i in range(0, 300, 5))


def test_knn_imputation_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0), (3, None, 8.0)], "id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in impute_knn(df, "id", ["a", "b"]).collect()}
    assert got[1] == (1.0, 6.0) and got[2] == (1.0, 4.0)


def test_blocks_of_the_silhouette_follow_the_table(spark, monkeypatch):
    """A row is shuffled once for each block: their number must not grow with the rows."""
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 16)
    df = spark.range(600).select("id", F.array(F.rand(1), F.rand(2) + F.col("id") % 3).alias("f"), (F.col("id") % 3).alias("k")).cache()
    got = clusters.silhouette(df, "f", "k", "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f", {clusters.BLOCKS - 1}, " in plan or f", {clusters.BLOCKS - 1})" in plan
    small = {r[0]: r[1] for r in clusters.silhouette(df, "f", "k", "id", block_rows=40).collect()}
    assert all(abs(small[r[0]] - r[1]) < 1e-9 for r in got.collect())


def test_isolation_scores_are_paths_and_made_once(spark):
    df = spark.range(400).select("id", *[(F.randn(seed=i) * (i + 1)).alias(c) for i, c in enumerate("abc")]).cache()
    forest = isolation.fit_forest(df, ["a", "b", "c"], trees=7, sample=64)
    rows = df.withColumn("s", isolation.anomaly_score(spark, forest, ["a", "b", "c"])).collect()
    for r in rows[:60]:
        total = 0.0
        for t in forest["trees"]:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] if r["abc"[t["feature"][at]]] <= t["cut"][at] else t["right"][at]
            total += t["length"][at]
        assert abs(r["s"] - 2.0 ** (-total / 7 / forest["norm"])) < 1e-12
    plan = isolation.flag_outliers(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan  # the scores are read, not computed again


def test_isolation_forest_flags_planted_rows(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 3))
    x[:20] += 12
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    out = isolation.flag_outliers(df, ["a", "b", "c"], contamination=0.1)
    flagged = {r["id"] for r in out.where("is_outlier").collect()}
    assert set(range(20)) <= flagged and abs(len(flagged) - 200) <= 20
    assert isolation.flag_outliers(df, ["a", "b"]).columns == df.columns


def test_confusion_measures_when_undefined(spark):
    df = spark.createDataFrame([(0, 0)] * 5, "label int, prediction int")
    row = metrics.agreement(metrics.confusion_counts(df)).first()
    assert row["mcc"] == 0.0 and row["kappa"] == 0.0 and row["balanced_accuracy"] == 1.0
    zero = spark.createDataFrame([(0.0, 1.0)], "label double, prediction double")
    assert metrics.regression_metrics(zero).first()["mape"] is None
    assert metrics.scorer(lambda p: p.agg(F.avg("label")), greater_is_better=False)(df) == 0.0


def test_pareto_front_rounds(spark, monkeypatch):
    monkeypatch.setattr(trials, "BLOCK_POINTS", 20)
    rng = np.random.default_rng(13)
    m = rng.integers(0, 12, size=(300, 3))
    df = spark.createDataFrame([(i, "COMPLETE", *map(int, r)) for i, r in enumerate(m)], "trial int, state string, a int, b int, c int")
    got = {r["trial"] for r in trials.pareto_front(df, {"a": "maximize", "b": "minimize", "c": "maximize"}).collect()}
    s = m * np.array([1, -1, 1])
    want = {i for i in range(300) if not any((s[j] >= s[i]).all() and (s[j] > s[i]).any() for j in range(300))}
    assert got == want
    one = {r["trial"] for r in trials.pareto_front(df, {"a": "maximize"}).collect()}
    assert one == {i for i in range(300) if m[i, 0] == m[:, 0].max()}


def test_skyline_of_many_points(spark):
    """200,000 points near a plane, where thousands stay: a point is copied to few blocks at any size."""
    rng = np.random.default_rng(15)
    names, copies = ["x", "y", "z"], {}
    for n in (50_000, 200_000):
        m = rng.dirichlet([1, 1, 1], n) * rng.random((n, 1))
        df = spark.createDataFrame(pd.DataFrame(m, columns=names))
        report: dict = {}
        front = trials._grid_front(df, names, block_points=2048, report=report)
        got = {tuple(r) for r in front.select(*names).collect()}
        kept = np.array(sorted(got))
        rest = np.array([p for p in m.tolist() if tuple(p) not in got])
        for some, beaten in ((kept, False), (rest[rng.integers(len(rest), size=5000)] if n > 50_000 else rest, True)):
            for at in range(0, len(some), 500):
                part = some[at : at + 500]
                above = (kept[None] >= part[:, None]).all(axis=2) & (kept[None] > part[:, None]).any(axis=2)
                assert (above.any(axis=1) == beaten).all()
        assert len(got) > 500
        copies[n] = report["copies"] / report["survivors"]
        assert report["survivors"] < n
    assert max(copies.values()) < 60  # blocks of cells, however many points stay


def test_skyline_of_nothing_and_of_equal_points(spark):
    empty = spark.createDataFrame([], "x double, y double, z double")
    assert trials._grid_front(empty, ["x", "y", "z"]).count() == 0
    same = spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double")
    assert trials._grid_front(same, ["x", "y", "z"]).count() == 1


def test_silhouette_estimate(spark):
    """The interval holds the exact value for most seeds; all rows give it exactly; ids are texts, rows repeat."""
    rng = np.random.default_rng(17)
    x = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(200, 8)) + 1.5, rng.normal(size=(100, 8)) - 2])
    x[10:20] = x[10]
    c = [0] * 300 + [1] * 200 + [2] * 100
    df = spark.createDataFrame([(f"r{i}", r.tolist(), k) for i, (r, k) in enumerate(zip(x, c))], "id string, f array<double>, k int")
    exact = clusters.silhouette_score(df, "f", "k", "id", block_rows=70).first()[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    per = np.stack([d[:, np.array(c) == k].sum(axis=1) for k in range(3)], axis=1)
    own, size = np.array(c), np.bincount(c)
    a = per[np.arange(600), own] / (size[own] - 1)
    per[np.arange(600), own] = np.inf
    b = (per / size).min(axis=1)
    assert exact == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-9)
    whole = clusters.silhouette_estimate(df, "f", "k", "id", rows=1000).first()
    assert whole["rows"] == 600 and whole["low"] == whole["high"] == pytest.approx(exact, abs=1e-9)
    held = [clusters.silhouette_estimate(df, "f", "k", "id", rows=80, seed=s).first() for s in range(10)]
    assert sum(r["low"] <= exact <= r["high"] for r in held) >= 8 and all(r["high"] - r["low"] < 0.12 for r in held)


def test_select_k_best(spark):
    rng = np.random.default_rng(14)
    y = rng.integers(0, 2, size=300)
    rows = [(float(v), float(v + 5 * k), int(k)) for v, k in zip(rng.normal(size=300), y)]
    df = spark.createDataFrame(rows, "noise double, signal double, y int")
    assert features.select_k_best(df, "y", 1).columns == ["signal", "y"]


def test_event_search_is_case_insensitive(spark):
    df = spark.createDataFrame([(1, "Disk FULL", "db", "x", "error"), (2, None, "web", "full_scan", "info")],
                               "event_id long, message string, source string, event_type string, level string")
    assert {r[0] for r in eventlog.search(df, text="Full").select("event_id").collect()} == {1, 2}
    assert eventlog.search(df, levels=["error"], text="full").count() == 1


def test_rank_correlations_of_many_columns(spark):
    """40 columns, some with missing values of equal and of different patterns; the number of jobs does not grow with them."""
    rng = np.random.default_rng(11)
    data = pd.DataFrame({f"c{i}": rng.integers(0, 12, 90) + 0.5 * i for i in range(40)})
    data["c0"] = 1.0  # no variance
    hidden, other = rng.random(90) < 0.3, rng.random(90) < 0.2
    data.loc[hidden, ["c1", "c2"]] = None
    data.loc[other, "c3"] = None
    df = spark.createDataFrame(data).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in data])
    jobs, sc = {}, spark.sparkContext
    for method, ours in (("spearman", association.spearman_matrix), ("kendall", association.kendall_matrix)):
        for width in (5, 40):
            sc.setJobGroup(f"{method}{width}", "")
            got = ours(df, list(data)[:width], bucket_rows=500).collect()
            jobs[width] = len(sc.statusTracker().getJobIdsForGroup(f"{method}{width}"))
            assert len(got) == width * (width - 1) // 2
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert jobs[40] <= jobs[5] + 6
        for r in got:
            both = data[[r["left_column"], r["right_column"]]].dropna().to_numpy().T
            # average ranks, and signs of all pairs of rows, correlate as rho and tau-b
            x, y = (ranks(v) - (len(v) + 1) / 2 if method == "spearman" else np.sign(v[:, None] - v[None, :]) for v in both)
            scale = math.sqrt((x * x).sum() * (y * y).sum())
            assert (r["r"] is None and not scale) or r["r"] == pytest.approx((x * y).sum() / scale, abs=1e-9), r


def test_rank_correlations_without_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    for ours in (association.spearman_matrix, association.kendall_matrix):
        assert [tuple(r) for r in ours(df, ["a", "b"]).collect()] == [("a", "b", None)]
        assert ours(df, ["a"]).collect() == []


def test_rank_correlations_look_up_frequent_values(spark):
    """Frequent values never reach the join, whose tasks follow the rows: a value of half the rows would meet in one."""
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.permutation(600) / 7, "b": rng.integers(0, 3, 600) * 1.0, "c": np.where(rng.random(600) < 0.5, 0.0, rng.permutation(600))})
    data.loc[rng.random(600) < 0.2, "c"] = None
    for columns in (["a", "b"], ["a", "b", "c"]):
        df = spark.createDataFrame(data[columns]).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
        found = association.spearman_matrix(df, columns, bucket_rows=50, frequent=20, task_cells=100)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [set" in plan
        for r in found.collect():
            x, y = (ranks(v) for v in data[[r["left_column"], r["right_column"]]].dropna().to_numpy().T)
            assert r["r"] == pytest.approx(np.corrcoef(x, y)[0, 1])
