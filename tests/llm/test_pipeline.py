"""The corpus pipeline on a small table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, item = text(70), text(30)
    docs = [(i, text(rng.randrange(20, 120)), "en" if i % 2 else "de") for i in range(200)]
    docs += [(1000 + i, docs[i][1], "en") for i in range(5)]  # exact copies
    docs += [(1100 + i, [*docs[10 + i][1], "tail"], "en") for i in range(5)]  # near copies
    docs += [(1200 + i, [*text(90), "vile", *text(40), "vile"], "en") for i in range(120)]  # toxic
    docs += [(1400 + i, [*text(100), *passage, *text(100)], "en") for i in range(4)]
    docs += [(1500 + i, [*text(80), *item, *text(80)], "en") for i in range(3)]
    rows = [(i, " ".join(t), lang, "s", len(" ".join(t))) for i, t, lang in docs]
    rows += [(1600, None, None, None, None), (1601, "", "en", "s", 0)]
    labels = [(i, 1, int(1200 <= i < 1320)) for i, *_ in rows if i % 4]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_planted_cases(spark, folder):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    clean = set(range(200)) | set(range(1400, 1404)) | {1600, 1601}
    assert set(got) == clean
    assert all(r["rate"] > 0 for r in got.values())
    n = [len(got[i]["text"].split()) for i in range(1400, 1404)]
    assert n == [270, 200, 200, 200]
    assert got[1401]["n_chars"] == len(got[1401]["text"])


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40").withColumn("score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_columns_with_names_of_its_own(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 or doc_id >= 1400")
    docs = docs.withColumns({c: F.lit(7) for c in ("_removed", "domain", "n_tokens", "rate", "n_removed")})
    out = corpus_pipeline.cut_repeats(spark, docs, folder)
    assert out.columns == docs.columns and out.where("_removed = 7").count() == docs.count()
    mixed = corpus_pipeline.mix(spark, docs, folder)
    assert mixed.columns == [*docs.columns, "mix_domain", "mix_n_tokens", "mix_rate"]
    assert mixed.where("rate = 7 and mix_rate > 0").count() == mixed.count() > 0
