"""Order statistics against numpy, with limits so low that every path runs."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import dist
from millrace.operators import split

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} double")


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "two"])
def test_exact_quantiles_bracketed(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=5000),
        "ties": rng.integers(0, 7, size=5000).astype(float),
        "heavy": np.where(rng.uniform(size=5000) < 0.4, 3.0, rng.normal(size=5000)),
        "two": np.repeat([1.0, 2.0], 2500),
    }[kind]
    got = dist.exact_quantiles(frame(spark, x.tolist()), ["x"], PROBS, small_rows=50)["x"]
    assert np.allclose(got, np.quantile(x, PROBS))
    assert dist.exact_quantiles(frame(spark, x.tolist()), ["x"], PROBS)["x"] == pytest.approx(list(np.quantile(x, PROBS)))


def test_exact_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert dist.exact_quantiles(df, ["x"], [0.5])["x"] == [None]
    assert dist.exact_quantiles(df, [], [0.5]) == {}


def test_running_totals_in_buckets(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.normal(size=2000))
    w = rng.integers(1, 9, size=len(x))
    df = spark.createDataFrame(list(zip(x.tolist(), w.tolist())), "x double, w long")
    rows = dist.running_totals(df, "x", {"before": "w"}, bucket_rows=100).orderBy("x").collect()
    assert [r["before"] for r in rows] == [0, *np.cumsum(w)[:-1].tolist()]


def test_running_totals_per_partition(spark):
    rows = [(g, float(i), g + 1) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, x double, w long")
    out = dist.running_totals(df, "x", {"before": "w"}, ["g"], bucket_rows=20).collect()
    assert all(r["before"] == r["x"] * (r["g"] + 1) for r in out)


def test_running_max_in_buckets(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=500)
    df = spark.createDataFrame(list(zip(map(float, range(500)), v.tolist())), "x double, v double")
    rows = dist.running_max(df, "x", "v", "top", bucket_rows=50).orderBy("x").collect()
    want = np.maximum.accumulate(v)
    assert rows[0]["top"] is None
    assert [r["top"] for r in rows[1:]] == want[:-1].tolist()


def test_value_ranks_and_many_quantiles(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 300, size=3000).astype(float)
    df = frame(spark, x.tolist())
    got = dist.many_quantiles(df, "x", 101)
    assert np.allclose(got, np.quantile(x, np.linspace(0, 1, 101)))
    ranks = {r["value"]: r["before"] for r in dist.value_ranks(df, "x", bucket_rows=40).collect()}
    assert all(ranks[v] == (x < v).sum() for v in np.unique(x))


def test_dense_codes_both_ways(spark):
    words = [f"w{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in reversed(words)], "v string")
    for limit in (10, 1000):
        codes = {r["v"]: r["code"] for r in dist.dense_codes(df, "v", small_rows=limit).collect()}
        assert [codes[w] for w in words] == list(range(300))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), a=st.integers(0, 5))
def test_hash_cuts(spark, n, a):
    df = spark.range(n)
    cut = dist.hash_cuts(df, "id", 7, [(a, 5)])[None][0]
    hashes = sorted(hashlib.md5(f"7:{i}".encode()).hexdigest() for i in range(n))
    kept = [h for h in hashes if h <= cut]
    assert kept == hashes[: n * a // 5]


def test_hash_cuts_with_a_hot_key(spark):
    """Copies of one key share a side and must not hide other ranks."""
    df = spark.range(90).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"))
    cut = dist.hash_cuts(df, "k", 42, [(1, 2)])[None][0]
    n = df.where(dist.hash_key("k", 42) <= cut).count()
    assert n >= 45 and cut


def test_quantiles_leave_out_nan_at_any_size(spark):
    rows = [(float("nan") if i % 10 == 0 else float("inf") if i % 10 == 1 else float(i % 7),) for i in range(1000)]
    df = spark.createDataFrame([*rows, (None,)], "x double")
    small, large = (dist.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.95], small_rows=n)["x"] for n in (10, 10**6))
    assert small == large == [0.0, 1.0, 3.0, float("inf")]


def test_hash_cuts_narrow_by_prefix(spark):
    """Classes of all sizes, NULL and odd names among them, with prefixes opened several times."""
    rows = [(i, None if i % 11 == 0 else ("" if i % 13 == 0 else f"c{i % 5}" if i % 2 else f"rare {i}")) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, c string")
    table = dist.hash_cut_table(df, "id", 3, [(1, 5), (1, 2), (1, 1)], "c", "ceil", small=2).collect()
    hashes: dict = {}
    for i, c in rows:
        hashes.setdefault(c, []).append(hashlib.md5(f"3:{i}".encode()).hexdigest())
    assert {r["_class"] for r in table} == set(hashes) and len(table) == len(hashes)
    for r in table:
        h = sorted(hashes[r["_class"]])
        assert r["_cuts"] == [h[math.ceil(len(h) / 5) - 1], h[math.ceil(len(h) / 2) - 1], h[-1]]


def test_hash_cuts_of_equal_keys(spark):
    df = spark.range(500).select(F.lit(7).alias("id"))
    h = hashlib.md5(b"1:7").hexdigest()
    assert dist.hash_cuts(df, "id", 1, [(1, 2), (0, 1), (1, 1)], small=3) == {None: [h, "", h]}


def test_a_million_strata(spark):
    """The table of classes never comes to the driver."""
    df = spark.range(2_000_000).select("id", (F.col("id") % 1_000_000).alias("c"))
    marked = split.mark_test(df, "id", 0.5, stratify="c")
    per = marked.groupBy("c").agg(F.sum(F.col("is_test").cast("int")).alias("n"))
    assert per.agg(F.count("*"), F.min("n"), F.max("n")).first() == (1_000_000, 1, 1)
