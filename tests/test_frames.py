"""Small frames: empty, one row, constant, all NULL, NaN, ties; and invariants."""

import pytest
from pyspark.sql import functions as F

from millrace.dist import nan_to_null
from millrace.operators import clean, encode, profile, scale, split, target
from millrace.plans.eda import eda_report
from millrace.plans.preprocess import fit_preprocessor
from millrace.sources import io

SCHEMA = "x double, k double, n double, s string"
FRAMES = {
    "empty": [],
    "one": [(1.0, 2.0, None, "a")],
    "mixed": [(float(i % 7), 2.0, None, "ab"[i % 2]) for i in range(40)] + [(float("nan"), 2.0, None, None)],
}


@pytest.fixture(params=FRAMES)
def small(request, spark):
    return request.param, nan_to_null(spark.createDataFrame(FRAMES[request.param], SCHEMA))


def test_profiles_survive(small):
    name, df = small
    info = {r["column_name"]: r for r in profile.numeric_summary(df).collect()}
    assert info["n"]["mean"] is None and info["n"]["median"] is None
    assert {r["column_name"] for r in profile.column_info(df).collect()} == set(df.columns)
    assert profile.duplicate_rows(df).first()["n_rows"] == len(FRAMES[name])
    assert {r["column_name"] for r in profile.schema_table(df).collect()} == set(df.columns)
    profile.outlier_report(df).collect()
    profile.feature_roles(df).collect()
    target.analyze_target(df, "s").collect()
    target.analyze_target(df, "x").collect()
    target.recommend_cleaning(df).collect()
    if name == "mixed":
        assert info["x"]["missing"] == 1 and info["k"]["std"] == 0.0
        assert {r["column_name"] for r in profile.constant_columns(df).collect()} == {"k", "n"}
        assert {r["column_name"] for r in profile.constant_columns(df, all_null=False).collect()} == {"k"}


def test_cleaning_and_scaling_survive(small):
    _, df = small
    out = clean.clean(df)
    out.collect()
    fitted = scale.fit_scaler(df.select("x", "k", "n"), {"x": "standard", "k": "minmax", "n": "robust"})
    assert fitted.transform(df).columns == df.columns
    fitted.transform(df).collect()


def test_eda_report(spark):
    df = nan_to_null(spark.createDataFrame(FRAMES["mixed"], SCHEMA))
    parts = eda_report(df, "s", ["x", "k"])
    assert set(parts) == {"distributions", "missing", "correlations", "target"}
    assert parts["distributions"].agg(F.sum("n")).first()[0] == 81


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "k double")
    for m in ("standard", "minmax", "robust"):
        assert [r[0] for r in scale.fit_scaler(df, m).transform(df).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("method", ["standard", "minmax", "robust", "maxabs", "power_yeo", "quantile_uniform", "quantile_normal", "none"])
def test_scaling_round_trip(spark, method):
    df = spark.createDataFrame([(i, float((i * 37) % 101) - 20) for i in range(101)], "id long, x double")
    fitted = scale.fit_scaler(df, {"x": method})
    back = fitted.inverse_transform(fitted.transform(df))
    got = {r["id"]: r["x"] for r in back.collect()}
    want = {r["id"]: r["x"] for r in df.collect()}
    tol = 1e-4 if method == "quantile_normal" else 1e-9
    assert all(got[i] == pytest.approx(want[i], abs=tol) for i in want)


def test_unknown_strategies_fail(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    for call in (
        lambda: scale.fit_scaler(df, {"x": "nope"}),
        lambda: encode.fit_encoder(df, strategy="nope"),
        lambda: clean.fit_missing(df, strategy="nope"),
        lambda: clean.drop_duplicates(df, ["s"]),
        lambda: io.write_dataset(df, "/tmp/x", "xml"),
    ):
        with pytest.raises(ValueError):
            call()


def test_onehot_rows_sum_to_one_at_most(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "s string")
    rows = encode.fit_onehot(df, drop_first=False).transform(df).collect()
    assert sorted(sum(r) for r in rows) == [0, 1, 1, 1]
    assert encode.fit_onehot(df).transform(df).columns == ["s_b", "s_c"]
    assert encode.fit_onehot(df, max_categories=2).transform(df).columns == ["s"]


def test_encoders_on_new_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 5.0)], "s string, y double")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "s string")
    assert [r[0] for r in encode.fit_labels(df, "s").transform(new).collect()] == [1, -1, 2]
    assert encode.fit_target_means(df, "s", "y", min_samples=0).transform(new).collect()[1][0] == 3.0
    assert encode.fit_frequency(df, "s").transform(new).collect()[0][1] == 1


def test_lookup_by_shuffle_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{i % 13}",) for i in range(200)], "s string")
    a = encode.fit_labels(df, "s").transform(df).groupBy("s").count().collect()
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 0)
    b = encode.fit_labels(df, "s").transform(df).groupBy("s").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_folds_partition_rows_and_strata(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3).cast("string"))
    sizes = [r["count"] for r in split.mark_folds(df, "id", 5).groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 1
    per = split.mark_folds(df, "id", 5, stratify="y").groupBy("y", "fold").count().collect()
    assert all(abs(r["count"] - 103 / 15) <= 1 for r in per)
    train, test = split.train_test_split(df, "id", stratify="y")
    assert train.count() + test.count() == 103 and test.count() == 21
    again = split.mark_test(df.repartition(7), "id").where("is_test").select("id")
    first = split.mark_test(df, "id").where("is_test").select("id")
    assert again.exceptAll(first).isEmpty() and first.exceptAll(again).isEmpty()


def test_nested_samples_grow(spark):
    a, b, c = split.nested_samples(spark.range(100), "id", [0.1, 0.5, 1.0])
    assert (a.count(), b.count(), c.count()) == (10, 50, 100)
    assert a.join(b, "id", "left_anti").isEmpty()


def test_clip_bounds_are_respected(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(1e6,), (None,)], "x double")
    fitted = clean.fit_iqr_clip(df)
    lo, hi = fitted.bounds["x"]
    row = fitted.transform(df).agg(F.min("x"), F.max("x"), F.count("x")).first()
    assert row[0] >= lo and row[1] <= hi and row[2] == 51


def test_remove_keeps_null_rows_of_clean_columns(spark):
    df = spark.createDataFrame([(float(i % 5), None if i == 3 else 1.0) for i in range(30)] + [(500.0, 1.0)], "x double, y double")
    out = clean.remove_outliers(df)
    assert out.count() == 30 and out.where("y IS NULL").count() == 1


def test_preprocessor_reuses_fitted_statistics(spark):
    df = spark.createDataFrame([(i, float(i), "abc"[i % 3], i % 2) for i in range(60)], "id long, x double, s string, y int")
    fitted = fit_preprocessor(df, "y", "standard", keep=["id"])
    one = fitted.transform(df.where("id = 10")).first()
    every = fitted.transform(df).where("id = 10").first()
    assert one == every
    with pytest.raises(KeyError):
        fit_preprocessor(df, "y", "no such preset")


def test_validate_format(spark):
    good = spark.createDataFrame([(i, "a") for i in range(12)], "a int, b string")
    assert io.validate_format(good).first()["ok"]
    assert io.validate_format(good.limit(3)).first()["message"] == "fewer than 10 rows"
    assert io.validate_format(good.limit(0)).first()["message"] == "no rows"
    assert io.validate_format(good.select("a")).first()["message"] == "fewer than 2 columns"
    assert "c" in io.validate_format(good.withColumn("c", F.lit(None).cast("int")), first_rows=10).first()["message"]


def test_safe_names(spark):
    rows = [("a/b?c d.csv", "b_c d.csv"), ("x/" + "n" * 300 + ".json", "n" * 250 + ".json"), ("m" * 300, "m" * 255)]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r[0] == r[1] for r in df.select(clean.safe_name(F.col("raw")), "want").collect())


def test_duplicates_by_subset(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "id int, s string, v int")
    assert {r["id"] for r in clean.drop_duplicates(df, ["s"], "first", "id").collect()} == {1, 3}
    assert {r["id"] for r in clean.drop_duplicates(df, ["s"], "last", "id").collect()} == {2, 3}
    assert {r["id"] for r in clean.drop_duplicates(df, ["s"], "none").collect()} == {3}
