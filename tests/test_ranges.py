"""Files read in byte ranges, with ranges of a few bytes."""

import csv
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.session import cut_lineage
from millrace.sources import io, ranges


@pytest.fixture
def narrow(spark):
    """Ranges of 64 bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


CELLS = ["x", "", "a,b", 'say "so"', "two\nlines", '"', '""', "\n\n", ' "', 'mid"dle', "é" * 30, ",", '",\n"', "long " * 40, "\r\nx"]


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "a", "b c"], *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_records_in_ranges(narrow, tmp_path, end):
    draw = random.Random(3)
    rows = [[str(i), draw.choice(CELLS), draw.choice(CELLS)] for i in range(150)]
    for part in range(2):
        written(tmp_path / f"p{part}.csv", rows[part::2], end)
    raw = ranges.lines(narrow, str(tmp_path))
    assert raw.rdd.getNumPartitions() > 30
    # an empty field is NULL unless it is quoted, and the writer does not quote it
    want = sorted((int(i), a or None, b or None) for i, a, b in rows)
    typed = io.read_csv(narrow, str(tmp_path), "id int, a string, `b c` string")
    assert sorted(map(tuple, typed.collect())) == want
    found = io.read_csv(narrow, str(tmp_path))
    assert found.dtypes == [("id", "int"), ("a", "string"), ("b c", "string")]
    assert sorted(map(tuple, found.collect())) == want


def test_a_record_over_many_ranges(narrow, tmp_path):
    text = "\n".join(f"line {i}, \"{i}\"" for i in range(200))
    written(tmp_path / "one.csv", [["1", text, "z"], ["2", "y", text]])
    got = io.read_csv(narrow, str(tmp_path / "one.csv"), "id int, a string, b string")
    assert sorted(map(tuple, got.collect())) == [(1, text, "z"), (2, "y", text)]


def test_unquoted_quotes_open_nothing(narrow, tmp_path):
    (tmp_path / "u.csv").write_text('\nid,a\n1,5" pipe\n\n2,it"s\n3,"q"\n4,last')
    got = io.read_csv(narrow, str(tmp_path / "u.csv"), "id int, a string")
    assert sorted(map(tuple, got.collect())) == [(1, '5" pipe'), (2, 'it"s'), (3, "q"), (4, "last")]


def test_states_follow_the_quotes(narrow, tmp_path):
    draw = random.Random(5)
    rows = [[draw.choice(CELLS) for _ in range(3)] for _ in range(200)]
    written(tmp_path / "s.csv", rows)
    text = (tmp_path / "s.csv").read_bytes()
    got = {r["start"]: r["inside"] for r in ranges.quote_states(ranges.lines(narrow, str(tmp_path))).collect()}
    assert len(got) > 50
    for start, inside in got.items():
        # a range begins after the first line feed at or after its start
        at = text.find(b"\n", start) + 1 if start else 0
        state = False
        for line in text[:at].split(b"\n")[:-1]:
            state = ranges.ends_inside(line, state, b",", b'"')
        assert inside == state


def test_empty_files(narrow, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n")
    got = io.read_csv(narrow, str(tmp_path), "id int, a string")
    assert got.collect() == [] and got.columns == ["id", "a"]


def digest(data, size):
    blocks = [hashlib.md5(data[i : i + size]).hexdigest() for i in range(0, len(data), size)] or [hashlib.md5(b"").hexdigest()]
    return blocks[0] if len(blocks) == 1 else hashlib.md5("".join(blocks).encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 50, 64, 300, 1 << 20])
def test_digests_do_not_depend_on_ranges(narrow, tmp_path, size):
    draw = random.Random(size)
    files = {
        "empty": b"", "feed": b"\n", "feeds": b"\n" * 150, "text": b"one\ntwo\n" * 40, "open": b"one\ntwo\n" * 40 + b"end",
        "none": b"x" * 500, "bytes": draw.randbytes(700), "a b%20é": draw.randbytes(64) + b"\n" + draw.randbytes(200),
    }
    if size == 1:
        files = {k: v[:100] for k, v in files.items()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = ranges.file_digests(narrow, str(tmp_path), size).select(F.element_at(F.split("path", "/"), -1), "bytes", "hash")
    want = {(len(d), digest(d, size)) for d in files.values() if d}  # Spark lists no file without bytes
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(files) - 1 and {r[1:] for r in rows} == want
