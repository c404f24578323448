"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives


def plain(rows, every=2, positives=5, n=3):
    """rows (id, label, vector) -> sorted result of anchors whose id is divisible by `every`."""
    live = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            if i not in live or (label, v) < live[i]:
                live[i] = (label, v)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in live.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:n]
            out += [(a, positive, k, i, -p, -s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every=2, **parameters):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = negatives.hard_negatives(negatives.whole_vectors(table), F.col("id") % every == 0, **parameters)
    return sorted(tuple(r) for r in found.collect())


def vectors(n, dim, seed, common=0.0, labels=3):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dim)) / math.sqrt(dim) + common
    return [(i, int(draw.integers(labels)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize(
    "rows, parameters",
    [
        (vectors(120, 8, 1), {}),
        (vectors(200, 16, 2, common=0.3), {"block_rows": 7, "pivots": 4, "batch_rows": 5}),
        (vectors(90, 3, 3, common=-0.2, labels=2), {"block_rows": 10, "positives": 2, "negatives": 4}),
    ],
)
def test_all_scores(spark, rows, parameters):
    kept = {"positives": parameters.get("positives", 5), "n": parameters.get("negatives", 3)}
    want = plain(rows, 2, **kept)
    assert want and run(spark, rows, **parameters) == want


def test_ties_copies_and_odd_rows(spark):
    unit = [0.5, 0.25, -0.125]
    rows = [(i, i % 2, unit) for i in range(12)]
    rows += [(20 + i, i % 2, [x * 0.8 for x in unit]) for i in range(10)]
    rows += [(40, None, unit), (41, 1, None), (42, 0, [0.5, None, 0.1]), (43, 1, [math.nan, 0.0, 0.0]), (44, 0, [math.inf, 0.0, 0.0]),
             (46, 0, [0.0, 0.0, 0.0]), (47, 1, [0.0, 0.0, 0.0]), (48, 0, []), (49, 1, []), (50, 0, [1.0]), (51, 1, [0.7]), (52, 0, [0.9]),
             (None, 1, unit), (20, 1, [9.0, 9.0, 9.0]), (54, 2, [-0.5, -0.25, 0.1]), (56, 2, [0.5, 0.25, -0.1])]
    want = plain(rows)
    assert want and run(spark, rows) == want


def test_no_window_and_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(2, 0, [1.0])]) == []
    assert run(spark, [(2, 0, [1.0]), (3, 0, [1.0])]) == []


def test_large_numbers_stay_exact(spark):
    draw = random.Random(5)
    rows = [(i, i % 3, [draw.uniform(1e5, 1e6) for _ in range(4)]) for i in range(40)]
    want = plain(rows)
    assert want and run(spark, rows) == want
    assert run(spark, [*rows, (99, 0, [1e300, 0.0, 0.0, 0.0])]) == want  # its scores do not fit


def test_text_ids_and_clashing_columns(spark):
    rows = [(f"v{i}", i % 2, [1.0 - 0.02 * i, 0.1], 1, 2) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id string, label int, embedding array<double>, block int, score int")
    got = negatives.hard_negatives(negatives.whole_vectors(table), F.col("id") == "v0", positives=1, negatives=2).collect()
    assert [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in got] == [("v0", "v2", 1, "v5"), ("v0", "v2", 2, "v7")]


@pytest.mark.parametrize("threshold", [-math.inf, -500.0, 0.0, 300.0, 900.0, 1e9])
def test_threshold_join(threshold):
    draw = np.random.default_rng(7)
    x, y = draw.integers(-20, 21, (30, 24)), draw.integers(-20, 21, (80, 24))
    y[5], y[6] = 0, x[3]
    limits = np.full(30, threshold) + (0 if math.isinf(threshold) else draw.integers(-50, 50, 30))
    a, r, s = negatives.threshold_join(x, y, limits, step=5)
    scores = x @ y.T
    want = {(i, j, int(scores[i, j])) for i in range(30) for j in range(80) if scores[i, j] >= limits[i]}
    assert {(int(i), int(j), int(k)) for i, j, k in zip(a, r, s)} == want and len(a) == len(want)
