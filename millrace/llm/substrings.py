"""Exact substring de-duplication with an FM-index per shard (operator 6).

A window is `width` consecutive words.  Its anchor is the smallest hash among
the word 8-grams inside it, so equal windows have equal anchors.  A segment is
a maximal run of windows with one anchor: about 20 windows, whose words go to
the shard of the anchor.  Every occurrence of a window is then in one shard,
and no text meets more than the shards of its own anchors: work is linear.

1. One pass emits segments (anchor, hash of the content, start).  Only anchors
   that occur in two documents can hold a repeated window; on natural text that
   leaves few segments.
2. Equal segments collapse to the smallest id, so a group of copies, however
   large, is one row.  The words of what is left are fetched once.
3. Per shard: an FM-index (suffix order, BWT, wavelet tree) over the distinct
   segments; the same segments are streamed through backward search, which
   gives matching statistics and, for each window that matches in full, the
   smallest id of its occurrences.
4. Reported intervals go back to all documents that hold the segment; words of
   windows that start in a smaller id are removed.

An anchor with more than `hot` distinct segments (a phrase in very many
contexts) would make one index too large.  The windows of such segments are
counted the plain exact way, by a 128-bit hash of all their words with map-side
combining; the same answer at any size.  As equal segments are one row there,
each carries the largest id of its holders besides the smallest.

Defined results: a null or empty text has no words; a null id is smaller than
none and larger than all, so its words go if the window is anywhere else and
null ids do not take from each other; rows with the same id are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .fmindex import FMIndex
from .text import U64, Words, as_long, constants, list_column, mixed, ngrams, sliced

GRAM = 8
LAST = np.iinfo(np.int64).max
KEY = ["anchor", "content"]


def _running_least(x: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of every `span` consecutive values, the first of ties."""
    n = len(x) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, size = x, np.arange(len(x)), 1
    while size < span:
        step = min(size, span - size)
        right = low[step:] < low[: len(low) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        low = np.where(right, low[step:], low[: len(low) - step])
        size += step
    return at


def segments(w: Words, width: int):
    """For all texts at once: text number, first word, number of words, anchor
    and content hash of each segment."""
    grams = ngrams(w.hash, GRAM)
    least = _running_least(grams, width - GRAM + 1)
    text_of = np.repeat(np.arange(len(w.ptr) - 1), w.counts())
    starts = np.flatnonzero(text_of[: len(least)] == text_of[width - 1 :][: len(least)]) if len(least) else least
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U64), none.view(U64)
    at = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text_of[starts[1:]] != text_of[starts[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, size = starts[first], count + width - 1
    base = int(constants(1, 505)[0])
    powers = np.full(len(w.hash) + 1, U64(base))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * powers[:-1], out=sums[1:])
    inverse = np.full(len(w.hash) + 1, U64(pow(base, -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    content = mixed((sums[begin + size] - sums[begin]) * inverse[begin] + size.astype(U64))
    return text_of[begin], begin - w.ptr[text_of[begin]], size, mixed(grams[at[first]]), content


def _segment_rows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in sliced(batches, "text"):
            row, begin, size, anchor, content = segments(Words(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(row)) for k in ("id", "tag")]
                + [pa.array(as_long(x)) for x in (anchor, content)]
                + [pa.array(x.astype(np.int32)) for x in (begin, size)],
                names=["id", "tag", *KEY, "begin", "size"],
            )

    return docs.mapInArrow(run, "id long, tag long, anchor long, content long, begin int, size int")


def _segment_words(picked: DataFrame) -> DataFrame:
    """picked (text, parts array<struct<anchor, content, owner, top, begin, size>>) -> one row of word hashes a part."""

    def run(batches):
        for batch in sliced(batches, "text", 1 << 19):
            w = Words(batch.column("text"))
            parts = batch.column("parts")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            flat = parts.flatten()
            begin = flat.field("begin").to_numpy() + w.ptr[rows]
            size = flat.field("size").to_numpy().astype(np.int64)
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            values = w.hash[np.repeat(begin, size) + inside]
            yield pa.RecordBatch.from_arrays(
                [flat.field(k) for k in (*KEY, "owner", "top")] + [list_column(as_long(values), size)],
                names=[*KEY, "owner", "top", "words"],
            )

    return picked.mapInArrow(run, "anchor long, content long, owner long, top long, words array<long>")


def _shard_matches(width: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        lists = shard.column("words").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        words = lists.flatten().to_numpy()
        lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        owner = np.repeat(shard.column("owner").to_numpy(), lengths + 1)
        index = FMIndex(words, lengths, owner, width)
        return _intervals(shard, index.matches(words, lengths), lengths, width)

    return run


def _intervals(shard: pa.Table, found: np.ndarray, lengths: np.ndarray, width: int) -> pa.Table:
    """Runs of windows with one smallest owner, as (from, to, owner) per segment."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = np.flatnonzero(found != LAST)
    row, offset, found = row[ok], offset[ok], found[ok]
    new = np.ones(len(row), bool)
    if len(row):
        new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    keys = shard.select(KEY).take(pa.array(row[first]))
    return pa.table(
        [keys.column(k) for k in KEY]
        + [
            pa.array(offset[first].astype(np.int32)),
            pa.array((offset[last] + width).astype(np.int32)),
            pa.array(found[first]),
        ],
        names=[*KEY, "lo", "hi", "least"],
    )


def _windows(parts: DataFrame, width: int) -> DataFrame:
    """The windows of segments, as 128-bit hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column("words")
                words = lists.flatten().to_numpy().view(U64)
                lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                row = np.repeat(np.arange(len(lengths)), lengths)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                ok = np.flatnonzero(offset + width <= lengths[row])
                h1, h2 = ngrams(words, width, 2)[ok], ngrams(words, width, 3)[ok]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k).take(pa.array(row[ok])) for k in (*KEY, "owner", "top")]
                    + [pa.array(offset[ok].astype(np.int32)), pa.array(as_long(h1)), pa.array(as_long(h2))],
                    names=[*KEY, "owner", "top", "lo", "h1", "h2"],
                )

    return parts.mapInArrow(run, "anchor long, content long, owner long, top long, lo int, h1 long, h2 long")


def _place(df: DataFrame, id_col: str, text_col: str) -> list:
    """Key of a row: its id (null: the largest long) and a hash of its text."""
    return [
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(int(LAST))).alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("tag"),
    ]


def repeated_intervals(
    docs: DataFrame, scratch: Scratch, width: int = 50, hot: int = 2000, shard_segments: int = 3000
) -> DataFrame:
    """docs (id, tag, text) -> id, tag, cuts: intervals of words whose windows start in a smaller id."""
    rows = scratch.write(_segment_rows(docs, width), "segments")
    anchors = rows.groupBy("anchor").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y")
    shared = scratch.write(rows.join(scratch.write(anchors.select("anchor"), "anchors"), "anchor"), "shared")
    scratch.drop("segments", "anchors")
    least = F.min(F.struct(F.col("id").alias("owner"), "tag", "begin", "size")).alias("at")
    distinct = shared.groupBy(*KEY).agg(least, F.max("id").alias("top"))
    distinct = scratch.write(distinct.select(*KEY, "at.*", "top"), "distinct")
    crowd = distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowd = scratch.write(crowd, "crowd")
    part = F.struct(*KEY, "owner", "top", "begin", "size")
    wanted = distinct.groupBy(F.col("owner").alias("id"), "tag").agg(F.collect_list(part).alias("parts"))
    wanted = scratch.write(wanted, "wanted")
    words = scratch.write(_segment_words(docs.join(wanted, ["id", "tag"]).select("text", "parts")), "words")

    shards = max(1, -(-distinct.count() // shard_segments))
    calm = words.drop("top").join(crowd, "anchor", "left_anti").withColumn("shard", F.pmod("anchor", F.lit(shards)))
    kind = "anchor long, content long, lo int, hi int, least long"
    indexed = calm.groupBy("shard").applyInArrow(_shard_matches(width), kind)
    windows = scratch.write(_windows(words.join(crowd, "anchor"), width), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("owner").alias("least"), F.max("top").alias("y"))
    first = scratch.write(first.where("least < y").drop("y"), "first")
    counted = windows.join(first, ["h1", "h2"]).select(*KEY, "lo", (F.col("lo") + width).alias("hi"), "least")
    found = scratch.write(indexed.unionByName(counted), "found")

    cuts = shared.join(found, KEY).where("least < id")
    cut = F.struct((F.col("begin") + F.col("lo")).alias("lo"), (F.col("begin") + F.col("hi")).alias("hi"))
    return cuts.select("id", "tag", cut.alias("cut")).groupBy("id", "tag").agg(F.collect_set("cut").alias("cuts"))


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    removed_col: str | None = None,
    **options,
) -> DataFrame:
    """docs with the text cut: words of windows that start in a document with a
    smaller id are gone, the others are joined by one space.  A text that loses
    nothing stays as it is, to the byte.  `removed_col` adds the number of words lost."""
    with Scratch(docs.sparkSession) as scratch:
        source = docs.select(*_place(docs, id_col, text_col), F.col(f"`{text_col}`").alias("text"))
        cuts = scratch.result(repeated_intervals(source, scratch, width, **options))
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_place(docs, id_col, text_col)
    )
    joined = keyed.join(cuts, ["id", "tag"], "left").select(
        *[F.col(f"row.`{c}`").alias(f"c{i}") for i, c in enumerate(names)], "cuts"
    )
    cut = apply_cuts(joined, f"c{names.index(text_col)}")
    return cut.toDF(*names, removed_col) if removed_col else cut.drop("n_removed").toDF(*names)


def apply_cuts(docs: DataFrame, text_col: str, cuts_col: str = "cuts") -> DataFrame:
    """Remove the word intervals in `cuts_col`, which gives way to `n_removed`."""
    keep = [c for c in docs.columns if c != cuts_col]

    def run(batches):
        for batch in sliced(batches, text_col):
            cuts, texts = batch.column(cuts_col), batch.column(text_col)
            lost = pa.array(np.zeros(len(cuts), np.int64))
            if cuts.null_count < len(cuts):
                texts, lost = _cut_texts(texts, cuts)
            yield pa.RecordBatch.from_arrays(
                [texts if c == text_col else batch.column(c) for c in keep] + [lost], names=[*keep, "n_removed"]
            )

    return docs.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_removed", T.LongType())]))


def _cut_texts(texts: pa.Array, cuts: pa.Array) -> tuple[pa.Array, pa.Array]:
    w = Words(texts)
    counts = pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), counts)
    flat = cuts.flatten()
    change = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(change, flat.field("lo").to_numpy() + w.ptr[row], 1)
    np.add.at(change, flat.field("hi").to_numpy() + w.ptr[row], -1)
    kept = np.cumsum(change[:-1]) == 0
    raw, out = w.data.tobytes(), texts.to_pylist()
    for i in np.flatnonzero(counts):
        span = range(w.ptr[i], w.ptr[i + 1])
        out[i] = b" ".join(raw[w.start[k] : w.end[k]] for k in span if kept[k]).decode("utf-8")
    lost = np.concatenate([[0], np.cumsum(~kept)])
    return pa.array(out, texts.type), pa.array(lost[w.ptr[1:]] - lost[w.ptr[:-1]])
