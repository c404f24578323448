"""Operator 1 against brute force."""

import random

from millrace.llm import minhash
from tests.llm.plain import components, shingles

SCHEMA = "doc_id long, text string, id string, kept string"


def rows_of(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).replace("w1", rng.choice(["w1", "W1"])))
    ids = rng.sample(range(1000), len(texts))
    return [(i, t, "x", "y") for i, t in zip(ids, texts)]


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    group = components(links)
    return {i: (len(sets[i]), group.get(i, i), group.get(i, i) == i) for i in ids}


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_chains_and_unlinked_variants_of_one_text(spark):
    """Many variants of a text that are all close to it, but not to each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base), "", "")]
    for i in range(1, 150):
        copy = list(base)
        for k in range(3 if i % 2 else 6):
            copy[rng.randrange(150)] = f"n{i}.{k}"
        rows.append((i, " ".join(copy), "", ""))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_defined_results(spark):
    long = "long " + " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (5, None, "", ""), (6, "", "", ""), (7, " \t\n", "", ""), (None, "a b c d e f", "", ""),
        (9, "a b c d e f", "", ""), (8, "A b  c d e\nf", "", ""), (8, "A b  c d e\nf", "", ""),
        (1, long, "", ""), (2, long + " end", "", ""), (3, "two words", "", ""), (4, "two Words", "", ""),
    ]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    n = 30_001 - 4
    assert got == sorted([
        (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 2, None, True),
        (9, 2, 8, False), (8, 2, 8, True), (8, 2, 8, True),
        (1, n, 1, True), (2, n + 1, 1, False), (3, 1, 3, True), (4, 1, 3, False),
    ], key=str)


def test_an_id_with_a_copied_and_a_near_copied_text_has_the_links_of_both(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(80)) for c in "uv")
    rows = [
        (3, first, "", ""), (5, first, "", ""), (5, second, "", ""), (9, second + " end", "", ""),
        (12, first + " end", "", ""), (7, "some other text of few words", "", ""),
    ]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (5, 3), (9, 3), (12, 3), (7, 7)}


def test_empty_table_and_dropping(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_duplicates(none).columns == none.columns
    rows = rows_of(3)
    left = minhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"] for r in left.collect()} == {i for i, v in brute(rows).items() if v[2]}
