"""Byte ranges of files, read in parallel and put in order by their ends.

Spark's line reader splits files and hands out each range's lines in order, with
the range they are from.  What a range starts with (inside a quoted field, at
which byte) follows from a short summary of each range before it, one row for
each range, so that no file is one row or one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ranges of the largest table that is joined by broadcast (128 TB at the usual 128 MB a range)
MOST_RANGES = 1_000_000


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, value): what stands between line feeds, as bytes; start tells the range."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"),
    )


def with_starts(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Lines with what is known of their range, in the order of the reader."""
    if known.count() > MOST_RANGES:
        raise ValueError("too many ranges: raise spark.sql.files.maxPartitionBytes")
    return rows.join(F.broadcast(known.select("file", "start", *columns)), ["file", "start"], "left")


def _runs(batches, columns: list[str]):
    """(first row's file, start and columns, values) of the rows of one range in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column("file"), batch.column("start")
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            extra = [batch.column(c)[at].as_py() for c in columns]
            yield file[at].as_py(), start[at].as_py(), extra, batch.column("value").slice(at, end - at)


# --------------------------------------------------------------------------
# quoted records
# --------------------------------------------------------------------------


def ends_inside(line: bytes, inside: bool, separator: bytes, quote: bytes) -> bool:
    """Whether a quoted field is open after a line; a quote opens a field only at its start."""
    at, opening = 0, separator + quote
    if not inside:
        if line.startswith(quote):
            at, inside = 1, True
        else:
            found = line.find(opening)
            if found < 0:
                return False
            at, inside = found + len(opening), True
    while True:
        found = line.find(quote, at)
        if found < 0:
            return True
        if line.startswith(quote, found + 1):  # doubled: a quote inside the field
            at = found + 2
            continue
        found = line.find(opening, found + 1)
        if found < 0:
            return False
        at = found + len(opening)


def quote_states(rows: DataFrame, separator: str = ",", quote: str = '"') -> DataFrame:
    """(file, start, inside): whether each range starts inside a quoted field.

    A range says where it ends for both ways it may start; a window over the
    ranges of a file follows the ways.
    """
    sep, mark = separator.encode(), quote.encode()

    def run(batches):
        now = None
        for file, start, _, values in _runs(batches, []):
            if now is None or now[:2] != [file, start]:
                if now is not None:
                    yield _row(now, schema)
                now = [file, start, False, True]
            for line in values.to_pylist():
                if mark in line:
                    same = now[2] == now[3]
                    now[2] = ends_inside(line, now[2], sep, mark)
                    now[3] = now[2] if same else ends_inside(line, now[3], sep, mark)
        if now is not None:
            yield _row(now, schema)

    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("closed", pa.bool_()), ("open", pa.bool_())])
    found = rows.mapInArrow(run, "file string, start long, closed boolean, open boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # a range either fixes its end, or keeps or swaps what it started with
    fixed, swaps = F.col("closed") == F.col("open"), F.when(F.col("closed") & ~F.col("open"), 1).otherwise(0)
    turned = found.withColumn("turns", F.coalesce(F.sum(swaps).over(before), F.lit(0)) + swaps)
    last = F.last(F.when(fixed, F.struct("closed", "turns")), ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("turns").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    known = turned.withColumn("last", last).withColumn("so_far", so_far)
    base = F.coalesce(F.col("last.closed"), F.lit(False)).cast("int")
    inside = (base + F.col("so_far") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    return known.select("file", "start", inside.alias("inside"))


def _row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def records(rows: DataFrame, states: DataFrame, separator: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """(record): each record of quoted text in one string, without the first of each file if `header`.

    A record that spans ranges leaves a piece in each; pieces are put together
    by the record that they belong to.
    """
    sep, mark = separator.encode(), quote.encode()
    kind = pa.schema(
        [("file", pa.string()), ("start", pa.int64()), ("piece", pa.int32()), ("first", pa.bool_()), ("record", pa.binary())]
    )

    def run(batches):
        here, inside, open_, fresh, head = None, False, [], False, False

        def flush():
            """The piece of a record that the range leaves open: 1 begins one, 0 goes on with one."""
            if open_:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip([*here, 0 if head else 1, fresh, b"\n".join(open_)], kind)], schema=kind
                )

        for file, start, (state,), values in _runs(batches, ["inside"]):
            if here != (file, start):
                yield from flush()
                if state is None:
                    raise RuntimeError("files were split in another way than before: keep the file settings of the session")
                here, inside, open_, fresh, head = (file, start), state, [], start == 0, state
            out = []  # (piece, first, record); piece is null for a whole record
            for line in values.to_pylist():
                if inside:
                    open_.append(line)
                    if mark in line:
                        inside = ends_inside(line, True, sep, mark)
                    if not inside:
                        out.append((0 if head else None, fresh, b"\n".join(open_)))
                        open_, head, fresh = [], False, False
                elif not line or line == b"\r":
                    continue  # no record
                elif mark in line and ends_inside(line, False, sep, mark):
                    inside, open_ = True, [line]
                else:
                    out.append((None, fresh, line))
                    fresh = False
            if out:
                piece, first, record = (pa.array(c, f.type) for c, f in zip(zip(*out), list(kind)[2:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(out)), pa.array([start] * len(out), pa.int64()), piece, first, record], schema=kind
                )
        yield from flush()

    marked = with_starts(rows, states, ["inside"])
    found = marked.mapInArrow(run, "file string, start long, piece int, first boolean, record binary")
    whole = found.where("piece is null").select("first", "record")
    order = Window.partitionBy("file").orderBy("start", "piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.where("piece is not null").withColumn("number", F.sum("piece").over(order))
    joined = pieces.groupBy("file", "number").agg(
        F.bool_or(F.col("first") & (F.col("piece") == 1)).alias("first"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start", "piece", "record"))), lambda p: p["record"].cast("string")),
            "\n",
        ).alias("record"),
    )
    every = whole.withColumn("record", F.col("record").cast("string")).unionByName(joined.select("first", "record"))
    text = F.regexp_replace("record", r"\r\z", "")
    kept = every.where(~F.col("first")) if header else every
    return kept.select(text.alias("record"))


# --------------------------------------------------------------------------
# digests
# --------------------------------------------------------------------------


def file_digests(spark: SparkSession, path: str | list[str], block_bytes: int = 1 << 22) -> DataFrame:
    """(path, bytes, hash) of each file: the md5 of its bytes if they fit in a block, else of its blocks' md5s.

    Blocks are cut at multiples of block_bytes whatever the ranges are.  A range
    hashes the blocks that it holds whole; of others it leaves its bytes, less
    than two blocks for each range, which are put together by block.
    """
    rows = lines(spark, path)
    files = spark.read.format("binaryFile").load(path)  # only listed
    sizes = files.select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    ranges = rows.groupBy("file", "start").agg(F.sum(F.octet_length("value") + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = ranges.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = places.join(sizes.select("file", "bytes"), "file")
    kind = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("digest", pa.string()), ("piece", pa.binary())]
    )

    def run(batches):
        here, at, end, held = None, 0, 0, bytearray()

        def cut(last: bool):
            """Blocks that are complete, and at the end of a range what is left of one."""
            nonlocal at
            out = []
            while held:
                room = block_bytes - at % block_bytes
                if len(held) < room and not last:
                    break
                part = bytes(held[:room])
                whole = at % block_bytes == 0 and (len(part) == block_bytes or at + len(part) == end)
                out.append((here[0], at // block_bytes, at, hashlib.md5(part).hexdigest() if whole else None, None if whole else part))
                del held[:room]
                at += len(part)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

        for file, start, (begin, size), values in _runs(batches, ["begin", "bytes"]):
            if here != (file, start):
                yield from cut(True)
                here, at, end = (file, start), begin, size
                held.clear()
            for line in values.to_pylist():
                held += line
                if at + len(held) < end:  # the last line may end without a line feed
                    held += b"\n"
                if len(held) >= block_bytes:
                    yield from cut(False)
        yield from cut(True)

    blocks = with_starts(rows, places, ["begin", "bytes"]).mapInArrow(
        run, "file string, block long, at long, digest string, piece binary"
    )
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])
    joined = F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p))
    digests = blocks.groupBy("file", "block").agg(F.coalesce(F.max("digest"), F.md5(joined)).alias("digest"))
    tops = digests.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("d"))
    root = F.when(F.size("d") == 1, F.col("d")[0]["digest"]).otherwise(
        F.md5(F.array_join(F.transform("d", lambda x: x["digest"]), ""))
    )
    return sizes.join(tops, "file").select("path", "bytes", root.alias("hash"))
