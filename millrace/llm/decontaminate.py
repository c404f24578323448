"""Benchmark items inside documents by size-partitioned MinHash (operator 5).

DataFrame functions only.  The containment of an item in a document is the
share of the item's five-word shingles that the document has.

1. A document's shingles are looked up among the shingles of all items; the
   others cannot change a containment, and without them a long document is a
   small set, of about the size of the items in it.
2. Documents are partitioned by the size of that set (powers of two).  A class
   of up to u shingles gets one-permutation MinHash with 8u bins: one minimum
   for each bin that has any.  Items are sketched once for each class, so both
   sides use the same bins, and a document and an item with an equal minimum
   are a candidate pair.
3. Candidates are verified by counting shared shingles.

A shared shingle is not the minimum of its bin with probability of at most 1/4
(document and item share 8u bins), so a leak of m shared shingles is missed
with (1/4)^(m * permutations).  Items take as many permutations as bring this
below 2e-11: one for 18 shared shingles or more, 18 for a single one.

Defined results: null or empty texts have no shingles and match nothing; a text
of fewer than five words has one shingle, its whole sequence; null ids on
either side match nothing; rows with the same id are one document (or item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lowered, words

#: m * permutations is at least this
TRIES = 18
#: a lookup of so many item shingles (16 bytes each) is broadcast, a larger one is shuffled
BROADCAST_ROWS = 1_000_000


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    # words are cut once; the array is a column of its own
    cut = rows.where("id is not null").select("id", words(lowered(F.col("text"))).alias("w"))
    n = F.size("w")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).when(n > 0, F.array(F.lit(1)))
    return cut.select("id", "w", F.explode(starts).alias("i")).select(
        "id", F.xxhash64(F.slice("w", F.col("i"), width)).alias("h")
    )


def _sketch(sets: DataFrame, permutations: Column) -> DataFrame:
    """sets (id, h, class) -> id, class, perm, low: the minimum of each bin."""
    tries = sets.withColumn("perm", F.explode(F.sequence(F.lit(1), permutations)))
    value = F.xxhash64("h", "perm")
    bins = F.lit(16) * F.pow(F.lit(2), F.col("class")).cast("long")
    binned = tries.select("id", "class", "perm", value.alias("v"), F.pmod(value, bins).alias("bin"))
    return binned.groupBy("id", "class", "perm", "bin").agg(F.min("v").alias("low")).drop("bin")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    percent: int = 75,
) -> DataFrame:
    """Pairs (document, item) with containment of at least percent / 100:
    id, item, n_shared, n_item, containment."""
    spark = docs.sparkSession
    documents = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    tests = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text"))
    with Scratch(spark) as scratch:
        parts = scratch.write(_shingles(tests, width).distinct(), "items")
        known = scratch.write(parts.select("h").distinct(), "known")
        lookup = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
        shared = scratch.write(_shingles(documents, width).join(lookup, "h", "left_semi").distinct(), "shared")

        sizes = shared.groupBy("id").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class"))
        classed = scratch.write(shared.join(sizes, "id"), "classed")
        classes = [r[0] for r in classed.select("class").distinct().collect()]  # at most 63 numbers
        q = parts.groupBy("id").agg(F.count("*").alias("n_item"))
        needed = F.ceil(F.col("n_item") * percent / 100)
        items_sized = scratch.write(
            q.select("id", "n_item", F.ceil(F.lit(float(TRIES)) / needed).cast("int").alias("perms")), "sizes"
        )
        most = items_sized.agg(F.max("perms")).first()[0] or 1
        sketch = _sketch(classed, F.lit(most))
        every = F.explode(F.array(*[F.lit(c) for c in sorted(classes)]).cast("array<int>"))
        probes = _sketch(parts.join(items_sized, "id").withColumn("class", every), F.col("perms"))
        probes = probes.select(F.col("id").alias("item"), "class", "perm", "low")
        pairs = sketch.join(probes, ["class", "perm", "low"]).select("id", "item").distinct()

        both = scratch.write(pairs, "pairs").join(parts.select(F.col("id").alias("item"), "h"), "item")
        counts = both.join(shared, ["id", "h"]).groupBy("id", "item").agg(F.count("*").alias("n_shared"))
        sized = counts.join(items_sized.select(F.col("id").alias("item"), "n_item"), "item")
        found = sized.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        return scratch.result(
            found.select(
                F.col("id").alias(id_col),
                F.col("item").alias(item_col),
                "n_shared",
                "n_item",
                (F.col("n_shared") / F.col("n_item")).alias("containment"),
            )
        )


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item."""
    found = leaks(docs, items, id_col=id_col, **options).select(id_col).distinct()
    return docs.join(found, id_col, "left_anti")
