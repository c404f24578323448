"""Manifest and proofs against plain trees."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, path of each node from the bottom, as (left, right))."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            run = at - at % 3
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        places = [at // 3 for at in places]
    return nodes[0], paths


def plain(rows, claims):
    """rows (id, source, text) -> sorted result rows."""
    order = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: [] for s in order}
    for r, c in zip(rows, claims):
        by[r[1]].append((r[0], H(*map(framed, r)), c))
    for s in by:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    lower = {s: tree([x[1] for x in by[s]]) for s in order}
    root, over = tree([lower[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for (i, leaf, claim), path in zip(by[s], lower[s][1]):
            whole, digest = path + above, claim or leaf
            for a, b in whole:
                digest = H(a, digest, b)
            proof = H("".join(a + b for a, b in whole))
            out.append((i, leaf, lower[s][0], root, proof, digest, digest == root))
    return sorted(out, key=repr)


def run(spark, rows, levels, tamper=False):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    altered = {"text": F.concat("text", F.lit("!"))} if tamper else None
    out = manifest.manifest(docs, ["doc_id", "source", "text"], "doc_id", "source", altered, levels)
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_trees_of_many_sizes(spark, levels):
    draw = random.Random(levels)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 28, "é": 82, "Z": 5, None: 7}
    rows = [(i, s, f"text {draw.random()}") for s, n in sizes.items() for i in range(n)]
    draw.shuffle(rows)
    assert run(spark, rows, levels) == plain(rows, [None] * len(rows))


def test_a_record_may_be_full(spark):
    rows = [(i, "s", "x") for i in range(730)]
    got = run(spark, rows, 6)
    assert got == plain(rows, [None] * 730) and all(r[-1] for r in got)


def test_altered_rows_do_not_verify(spark):
    rows = [(i, f"s{i % 3}", None if i % 4 == 0 else f"t{i}") for i in range(40)]
    claims = [H(framed(i), framed(s), framed(t and t + "!")) for i, s, t in rows]
    got = run(spark, rows, 2, tamper=True)
    assert got == plain(rows, claims)
    assert [r[-1] for r in got] == [r[0] % 4 == 0 for r in got]


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None)] * 3 + [(5, "s", "x")] * 4 + [(5, "s", "y"), (None, "s", "z"), (6, "s", None), (1, "", "")]
    assert run(spark, rows, 1) == plain(rows, [None] * len(rows))


def test_one_row_has_an_empty_proof(spark):
    (row,) = run(spark, [(1, "s", "x")], 6)
    assert row[1] == row[2] == row[3] == row[5] and row[4] == H("") and row[6]


def test_no_rows(spark):
    assert run(spark, [], 6) == []


def test_many_sources_and_clashing_columns(spark):
    rows = [(i, f"source {i}", "x", "at", 1, 2) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, tree string, idx int, digest int")
    out = manifest.manifest(docs, ["doc_id", "source", "text"], "doc_id", "source", None, 2)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain([r[:3] for r in rows], [None] * 100)


def test_framing_keeps_fields_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-")], "x string, y string")
    got = [r[0] for r in rows.select(manifest.leaf_digest(F.col("x"), F.col("y"))).collect()]
    assert got == [H("1:a", "2:bc"), H("2:ab", "1:c"), H("-", "1:-")]
