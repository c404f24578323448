"""Repeated lines against a plain form."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def plain(docs, least_docs=3, least_chars=20):
    """[(id, text)] -> {(id, text): (n_lines, n_dropped, kept)}."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in docs:
        every = (text or "").split("\n")
        ids = [held.get(key(line), ()) if i is not None else () for line in every]
        left = [line for line, h in zip(every, ids) if len(h) < least_docs or max(h) == i]
        out[i, text] = (len(every), len(every) - len(left), "\n".join(left))
    return out


def run(spark, docs, kind="long"):
    rows = spark.createDataFrame(docs, f"doc_id {kind}, text string")
    marked = lines.mark_lines(rows)
    return marked.select("doc_id", "text", "n_lines", "n_dropped", lines.kept_text(F.col("text"), F.col("keep")).alias("k"), "keep")


def check(spark, docs, kind="long"):
    got = run(spark, docs, kind).collect()
    want = plain(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_lines"], r["n_dropped"], r["k"]) == want[r["doc_id"], r["text"]], r["doc_id"]
        assert (r["keep"] is None) == (r["n_dropped"] == 0)


LONG = "A line that is long enough to count"


def test_cases(spark):
    often = [(i, f"own {i}\n{LONG}\n\n  {LONG.upper()} \r\nend") for i in range(6)]
    others = [
        (10, None),
        (11, ""),
        (12, "\n\n"),
        (13, LONG),
        (14, "x" * 19 + "\n" + "y" * 20),
        (15, "y" * 20 + "\n" + "x" * 19),
        (16, "\t" + "Y" * 20 + "\x0b\n" + "x" * 19),
        (None, LONG + "\n" + LONG),
        (None, None),
        (20, "É accent makes another line here"),
        (21, "é accent makes another line here"),
        (22, "É ACCENT makes another line here"),
        (23, "É accent MAKES another line here"),
        (24, " not stripped, a wide blank "),
        (25, "not stripped, a wide blank"),
        (26, "not stripped, a wide blank\u0085"),
    ]
    check(spark, often + others)


def test_repeated_ids_are_one_document(spark):
    text = f"{LONG}\n{LONG}\nrest"
    check(spark, [(1, text), (1, LONG), (1, LONG + "\nmore"), (2, LONG)])
    check(spark, [(1, text), (1, LONG), (2, LONG), (3, LONG + "\nlast")])


def test_equal_rows_and_text_ids(spark):
    rows = [(i, LONG) for i in "bcadd"]
    got = run(spark, rows, "string").collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["k"]) for r in got) == [
        ("a", 1, ""), ("b", 1, ""), ("c", 1, ""), ("d", 0, LONG), ("d", 0, LONG)]


def test_bitmaps_of_many_words(spark):
    shared = [f"shared line number {i:06d} of many" for i in range(400)]
    own = [f"only here {i}" for i in range(400)]
    docs = []
    for d in range(4):
        chosen = [s if (i * 7 + d) % 5 and not 130 <= i < 270 else o for i, (s, o) in enumerate(zip(shared, own))]
        docs.append((d, "\n".join(chosen)))
    check(spark, docs)
    words = run(spark, docs).where("doc_id = 0").first()["keep"]
    assert [w["word"] for w in words] == [0, 1, 2, 4, 5, 6]  # lines 192 to 255 are all kept


def test_empty_and_clashing_columns(spark):
    assert run(spark, []).count() == 0
    rows = [(i, LONG, 1, 2, 3, 4) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep int, n_lines int, t int, h1 int")
    got = lines.mark_lines(docs).orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in got] == [1, 1, 0]


@pytest.mark.parametrize("least_docs", [2, 4])
def test_limits(spark, least_docs):
    docs = spark.createDataFrame([(i, "short line") for i in range(3)], "doc_id long, text string")
    got = lines.mark_lines(docs, least_docs=least_docs, least_chars=5)
    assert got.agg(F.sum("n_dropped")).first()[0] == (2 if least_docs == 2 else 0)


def test_long_text(spark):
    """A text of 100,000 lines; the time of a bitmap is linear in them."""
    text = "\n".join(f"line {i % 50_000} of a very long text" for i in range(100_000))
    docs = [(i, text) for i in range(3)]
    got = run(spark, docs).orderBy("doc_id").select("n_lines", "n_dropped", F.sha2("k", 256).alias("h")).collect()
    whole, none = hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in got] == [(100_000, 100_000, none)] * 2 + [(100_000, 0, whole)]
