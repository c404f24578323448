"""Lines that many documents repeat, as keep bitmaps (operator 12).

DataFrame functions only; texts are read once for their lines' hashes, and only
hashes are shuffled.

1. Every line of a document becomes its key (blanks at both ends stripped, A-Z
   lower-cased), a 128-bit hash of it, the document and the position.
2. The hashes are range-partitioned and sorted by hash, then document
   (largest first), then position.  The range covers the document and the
   position too, so a line that a third of all documents hold is cut into many
   ranges.  Streaming through a range gives the first occurrence of each hash
   in each document; per range one partial count and one largest document leave
   for each hash.
3. A hash of at least `least_docs` documents drops its lines everywhere but in
   the largest document.  Dropped positions become bits of 64-line words, which
   are combined before they are shuffled.

The result is one row per row of documents with `n_lines`, `n_dropped` and
`keep`: the 64-line words with a dropped line in order, as (word, bits), bit i
set if line 64 * word + i stays.  Words that are not listed stay whole, so a
document that loses nothing has a null bitmap.  `kept_text` applies a bitmap.

Defined results: a null or empty text is one empty line; rows with the same id
are one document, whose lines count once and are dropped in all its rows alike;
rows with a null id are no document: they lose nothing and count for nothing.
Ids keep their type; the largest is as Spark orders them.  Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: what is stripped from both ends of a line: space and the control characters 9 to 13
BLANKS = " \t\n\x0b\x0c\r"
KEEP = "array<struct<word:int,bits:bigint>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ascii_lowered(text: Column) -> Column:
    """Equal for two texts if and only if they are equal with A-Z lower-cased.

    `translate` costs a lookup for each character; `lower` does not, but also
    changes letters beyond A-Z.  Read byte by byte, it changes lead bytes of
    UTF-8 in a way that the number of following bytes undoes.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")))


def occurrences(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, id, t, pos) of every line whose key has at least least_chars code points; t tells rows of one id apart."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.where(id_.isNotNull()).select(id_.alias("id"), F.xxhash64(text).alias("t"), F.posexplode(lines_of(text)))
    keyed = rows.withColumn("key", F.btrim("col", F.lit(BLANKS))).where(F.length("key") >= least_chars)
    same = _ascii_lowered(F.col("key"))
    return keyed.select(F.xxhash64(same).alias("h1"), F.xxhash64(F.lit(1), same).alias("h2"), "id", "t", "pos")


def repeated(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, last): hashes that at least least_docs documents hold, and the largest of them."""
    order = ["h1", "h2", F.desc("id"), "t", "pos"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    firsts = ranges.groupBy("h1", "h2", "id").agg(F.min(F.struct("t", "pos")).alias("first"))
    heads = firsts.groupBy("h1", "h2").agg(F.count("first").alias("n"), F.max("id").alias("last"))
    return heads.where(F.col("n") >= least_docs).drop("n")


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_docs: int = 3,
    least_chars: int = 20,
) -> DataFrame:
    """(id, t, n_dropped, keep) of the rows that lose a line; t is xxhash64 of the text."""
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.write(occurrences(docs, id_col, text_col, least_chars), "lines")
        heads = scratch.write(repeated(lines, least_docs), "heads")
        lost = lines.join(heads, ["h1", "h2"]).where("id <> last")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
        words = lost.groupBy("id", "t", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone"))
        kept = F.struct("word", F.bitwise_not("gone").alias("bits"))
        maps = words.groupBy("id", "t").agg(
            F.sum(F.bit_count("gone")).alias("n_dropped"), F.array_sort(F.collect_list(kept)).alias("keep")
        )
        return scratch.result(maps)


def mark_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Rows of docs as (id, text, n_lines, n_dropped, keep); id and text keep their names."""
    maps = keep_bitmaps(docs, id_col, text_col, **limits)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = rows.withColumn("t", F.xxhash64("text")).join(maps, ["id", "t"], "left")
    return marked.select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
    )


def line_flags(keep: Column) -> Column:
    """A bitmap as booleans, true for a line that stays; lines beyond the last listed word stay."""
    before = F.concat(F.array(F.lit(-1)), F.transform(keep, lambda k: k["word"]))

    def padded(k, last):
        whole = F.array_repeat(F.lit(-1).cast("long"), k["word"] - last - 1)
        return F.when(k.isNull(), F.array().cast("array<bigint>")).otherwise(F.concat(whole, F.array(k["bits"])))

    words = F.flatten(F.zip_with(keep, before, padded))
    places = F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(words, lambda w: F.transform(places, lambda i: F.getbit(w, i) == 1)))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that stay, joined by line feeds; the whole text where the bitmap is null."""
    stays = F.zip_with(lines_of(text), line_flags(keep), lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    left = F.array_join(F.filter(stays, lambda line: line.isNotNull()), "\n")
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(left)
