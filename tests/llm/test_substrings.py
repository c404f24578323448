"""Operator 6: the FM-index and whole documents against brute force."""

import random

import numpy as np

from millrace.llm import substrings
from millrace.llm.fmindex import FMIndex, Wavelet
from tests.llm.plain import words

SCHEMA = "doc_id long, text string, tag string, cuts string, n_removed string"


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 11, 400)
    tree = Wavelet(s, 11)
    at, symbol = rng.integers(0, 401, 200), rng.integers(0, 11, 200)
    assert tree.rank(symbol, at).tolist() == [int((s[:p] == c).sum()) for p, c in zip(at, symbol)]


def test_matching_statistics():
    rng = np.random.default_rng(2)
    for width in (3, 5, 8):
        lengths = rng.integers(1, 30, 25)
        text = rng.integers(0, 3, lengths.sum()).astype(np.int64) * 1000
        owner = rng.integers(0, 9, len(lengths))
        index = FMIndex(text, lengths, np.repeat(owner, lengths + 1), width)
        q_lengths = rng.integers(1, 40, 12)
        query = rng.integers(0, 4, q_lengths.sum()).astype(np.int64) * 1000  # 3000 is not in the index
        got = index.matches(query, q_lengths)
        pieces = np.split(text, np.cumsum(lengths)[:-1])
        want, at = [], 0
        for part in np.split(query, np.cumsum(q_lengths)[:-1]):
            for i in range(len(part)):
                w = part[i : i + width]
                hits = [
                    o for o, p in zip(owner, pieces) for k in range(len(p) - width + 1)
                    if len(w) == width and (p[k : k + width] == w).all()
                ]
                want.append(min(hits, default=np.iinfo(np.int64).max))
        assert got.tolist() == want


def brute(rows, width):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, 1 << 62), i if i is not None else 1 << 62)
    out = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i if i is not None else 1 << 62):
                gone |= set(range(k, k + width))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, len(gone)))
    return sorted(out, key=str)


def documents(seed, width):
    rng = random.Random(seed)
    shared = [[f"s{j}.{k}" for k in range(rng.choice([width - 1, width, width + 9, 3 * width]))] for j in range(5)]
    rows = []
    for i in rng.sample(range(100), 40):
        text = []
        for _ in range(rng.randrange(4)):
            text += [f"u{rng.randrange(30)}" for _ in range(rng.randrange(40))]
            text += rng.choice(shared) * rng.choice([1, 1, 2])
        rows.append((i, "  ".join(text), "", "", ""))
    return rows


def cut(spark, rows, **options):
    out = substrings.remove_repeated(spark.createDataFrame(rows, SCHEMA), removed_col="lost", **options)
    assert out.columns == ["doc_id", "text", "tag", "cuts", "n_removed", "lost"]
    return sorted(((r["doc_id"], r["text"], r["lost"]) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rows = documents(1, 50)
    assert cut(spark, rows) == brute(rows, 50)
    rows = documents(2, 12)
    assert cut(spark, rows, width=12, shard_segments=7) == brute(rows, 12)


def test_anchors_in_many_contexts_take_the_other_exact_way(spark):
    rows = documents(3, 12)
    assert cut(spark, rows, width=12, hot=1) == brute(rows, 12)


def test_copies_of_whole_documents_are_cut_the_other_exact_way(spark):
    rng = random.Random(4)
    rows = documents(4, 12)
    for i, n in enumerate((2, 3, 5)):  # copies that no other document has a word of
        text = " ".join(f"c{i}.{rng.randrange(40)}" for _ in range(90))
        rows += [(200 + 10 * i + k, text, "", "", "") for k in range(n)]
    rows += [(300 + r[0], r[1], "", "", "") for r in rows[:8]]
    want = brute(rows, 12)
    assert sum(n for *_, n in want) > 600
    assert cut(spark, rows, width=12) == want
    assert cut(spark, rows, width=12, hot=1) == want
    assert cut(spark, rows, width=12, hot=0) == want


def test_defined_results(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (4, passage, "", "", ""), (4, passage, "", "", ""), (9, f"x {passage}\ty", "", "", ""), (1, None, "", "", ""),
        (2, "", "", "", ""), (None, passage, "", "", ""), (None, f"{passage} z", "", "", ""), (8, "De " * 3000, "", "", ""),
        (7, "De " * 70, "", "", ""), (3, "a\n b ", "", "", ""), (4, "other text of four", "", "", ""),
    ]
    assert cut(spark, rows) == brute(rows, 50)
    assert cut(spark, rows[:0]) == []
