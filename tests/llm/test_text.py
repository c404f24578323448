"""Words, components and scratch tables."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.common import Scratch
from millrace.llm.components import connected_components
from millrace.llm.text import Words, ngrams, shingle_sets, sliced

TEXTS = ["a b\tc\x0bd  e f", None, "", "   ", "é x A.b\nC", "one"]


def plain(text):
    return (text or "").encode().split()


def test_words_are_those_of_plain_splitting():
    w = Words(pa.array(TEXTS))
    raw = w.data.tobytes()
    for i, t in enumerate(TEXTS):
        assert [raw[a:b] for a, b in zip(w.start[w.ptr[i] : w.ptr[i + 1]], w.end[w.ptr[i] : w.ptr[i + 1]])] == plain(t)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = Words(pa.array(["x yy x", "yy X"]), lower=True)
    x, yy = w.hash[0], w.hash[1]
    assert w.hash.tolist() == [x, yy, x, yy, x] and x != yy
    again = Words(pa.array(["", "yy"]).slice(1))
    assert again.hash.tolist() == [yy]


def test_shingles():
    texts = ["a b c d e f", "b c d e f", "a b", None, "a b c d e a b c d e"]
    sets = shingle_sets(Words(pa.array(texts)), 5)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 5]
    assert sets[1][0] in sets[0]
    assert len(ngrams(np.arange(3, dtype=np.uint64), 5)) == 0


def test_slices_lose_nothing():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 9, 50, 1, 1)] + [None])], names=["t"])
    parts = list(sliced([batch], "t", 10))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) > 1


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    with Scratch(spark) as scratch:
        got = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    with Scratch(spark) as scratch:
        assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_scratch_tables_are_deleted(spark):
    with Scratch(spark) as scratch:
        df = scratch.write(spark.range(3).toDF("x"), "some")
        path = scratch.paths[0]
        assert df.count() == 3
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
