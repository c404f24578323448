"""Near-duplicate documents by b-bit MinHash (operator 1).

1. One pass over the texts keeps, for each document, the size and a 128-bit
   fingerprint of its set of word shingles, one key per band of minima, and the
   low bits of all minima packed into longs.
2. Documents with the same set collapse to the smallest id.
3. Bands: in each bucket the smallest id is the centre.  Pairs (member, centre)
   whose collision-corrected estimate is high enough are confirmed on full sets.
4. Documents of buckets that still hold several components are searched to the
   end.  Their shingles are ordered from rare to common; two sets that reach the
   threshold share one of their first shingles, and what can follow the first
   shared one bounds the intersection (an exact prefix and position filter).
   Pairs of different components that pass this and the estimate, both inside
   the join condition, are confirmed as well.  Pairs inside a component are
   never formed or compared with each other where the largest component of a
   shingle is concerned, so a group of copies costs its size and not its square.

With 32 bands of 3 rows a pair of similarity 0.75 is missed with probability
(1 - 0.75^3)^32 = 2e-8; the estimate (96 minima, standard error 0.05) is cut at
0.5, five errors below the threshold.

Defined results: a null or empty text has no shingles and links with nothing; a
null id belongs to no component and is kept; rows with the same id are one
document, whose links are those of all its rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .text import U64, Words, as_long, constants, list_column, mixed, shingle_sets, sliced

BITS = 4
#: the lowest bit of every group of four
LOW_BITS = 0x1111111111111111


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(U64).max, U64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, width: int = 5, bands: int = 32, rows: int = 3) -> DataFrame:
    """docs (id, text) -> id, n_shingles, fp1, fp2, sig array<long>, bands array<long>."""
    n = bands * rows
    if n * BITS % 64:
        raise ValueError("bands * rows must be a multiple of 16")

    def run(batches):
        a, b, fold = constants(n, 101), constants(n, 202), constants(rows, 303)
        shift = (U64(BITS) * np.arange(64 // BITS, dtype=U64))[None, :]
        salt = constants(bands, 404)
        for batch in sliced(batches, "text"):
            sets = shingle_sets(Words(batch.column("text"), lower=True), width)
            low = np.array([_minima(s, a, b) for s in sets]).reshape(len(sets), n)
            some = np.array([len(s) > 0 for s in sets])
            keys = mixed((low.reshape(-1, bands, rows) * fold).sum(axis=2, dtype=U64) + salt)
            kept = mixed(low) & U64((1 << BITS) - 1)
            packed = (kept.reshape(len(sets), -1, 64 // BITS) << shift).sum(axis=2, dtype=U64)
            fp1 = np.array([s.sum(dtype=U64) for s in sets], U64)
            fp2 = np.array([mixed(s).sum(dtype=U64) for s in sets], U64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(as_long(fp1)),
                    pa.array(as_long(fp2)),
                    list_column(as_long(packed).ravel(), np.full(len(sets), packed.shape[1])),
                    list_column(as_long(keys[some]).ravel(), np.where(some, bands, 0)),
                ],
                names=["id", "n_shingles", "fp1", "fp2", "sig", "bands"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"id {kind}, n_shingles long, fp1 long, fp2 long, sig array<long>, bands array<long>"
    )


def estimate(x: Column, y: Column, minima: int) -> Column:
    """Similarity from packed low bits, corrected for chance collisions."""
    differ = F.lit(0)
    for i in range(minima * BITS // 64):
        z = x[i].bitwiseXOR(y[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(LOW_BITS)))
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(minima))) - chance) / (1 - chance)


def _common(pairs: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, ta, tb) -> a, b, na, nb, both: sizes of the sets and of what they share."""

    def run(batches):
        for batch in sliced(sliced(batches, "ta"), "tb"):
            x = shingle_sets(Words(batch.column("ta"), lower=True), width)
            y = shingle_sets(Words(batch.column("tb"), lower=True), width)
            both = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")]
                + [pa.array(v, pa.int64()) for v in ([len(s) for s in x], [len(t) for t in y], both)],
                names=["a", "b", "na", "nb", "both"],
            )

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, na long, nb long, both long")


def _shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    """texts (id, text) -> id, tag (of the text), h: a row for each distinct shingle."""

    def run(batches):
        for batch in sliced(batches, "text"):
            sets = shingle_sets(Words(batch.column("text"), lower=True), width)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            flat = np.concatenate(sets)
            for at in range(0, len(flat), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(row[part])) for c in ("id", "tag")]
                    + [pa.array(as_long(flat[part]))],
                    names=["id", "tag", "h"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.withColumn("tag", F.xxhash64("text")).mapInArrow(run, f"id {kind}, tag long, h long")


def _across(texts: DataFrame, found: DataFrame, close: Column, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold.

    texts (id, text), found (id, component, size of the component, sig)."""
    rows = scratch.write(_shingle_rows(texts, width), "tokens")
    often = scratch.write(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = rows.join(often, "h", "left").groupBy("id", "tag").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("s")
    )
    n = F.size("s")
    first = F.slice("s", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    prefix = ranked.select("id", n.alias("n"), F.posexplode(first).alias("i", "t"))
    prefix = prefix.where("t.df > 1").select("id", (F.col("n") - F.col("i")).alias("rest"), "n", F.col("t.h").alias("h"))
    prefix = scratch.write(prefix.join(found, "id"), "prefix")
    major = prefix.groupBy("h").agg(
        F.max_by("component", F.struct("size", "component")).alias("major"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
    )
    major = scratch.write(major.where("lo <> hi").select("h", "major"), "major")
    minor = scratch.write(prefix.join(major, "h").where("component <> major").drop("major"), "minor")
    cols = ["id", "component", "sig", "n", "rest"]
    left = minor.select("h", *[F.col(c).alias(f"{c}_a") for c in cols]).withColumnRenamed("sig_a", "sa")
    right = prefix.select(F.col("h").alias("hb"), *[F.col(c).alias(f"{c}_b") for c in cols]).withColumnRenamed("sig_b", "sb")
    # |x and y| >= percent / (100 + percent) * (|x| + |y|), and at most what is left of either
    enough = (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = (F.col("h") == F.col("hb")) & (F.col("component_a") != F.col("component_b")) & enough & close
    pairs = left.join(right, met).select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))
    return pairs.distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    bands: int = 32,
    rows: int = 3,
    least_estimate: float = 0.5,
) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one for each row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with Scratch(spark) as scratch:
        sketch = scratch.write(sketches(source, width, bands, rows), "sketch")
        named = sketch.where("id is not null and n_shingles > 0")
        copies = scratch.write(
            named.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"),
            "copies",
        )
        same = named.select("id", "fp1", "fp2").join(copies, ["fp1", "fp2"]).where("id <> rep")
        same = scratch.write(same.select(F.col("id").alias("a"), F.col("rep").alias("b"), "fp1", "fp2").distinct(), "same")
        copied = same.select(F.col("a").alias("id"), "fp1", "fp2")
        distinct = named.join(copied, ["id", "fp1", "fp2"], "left_anti")
        keys = scratch.write(distinct.select("id", F.explode("bands").alias("key")), "keys")
        buckets = scratch.write(
            keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n"),
            "buckets",
        )
        members = scratch.write(keys.join(buckets, "key"), "members")
        scratch.drop("keys", "buckets")
        wanted = members.select("id").distinct()
        texts = scratch.write(source.join(wanted, "id", "left_semi"), "texts")
        sigs = scratch.write(sketch.select("id", "sig").join(wanted, "id", "left_semi"), "sigs")

        def confirm(pairs: DataFrame) -> DataFrame:
            sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
                texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
            )
            both = F.col("both")
            return (
                _common(sides.select("a", "b", "ta", "tb"), width)
                .where(100 * both >= percent * (F.col("na") + F.col("nb") - both))
                .select("a", "b")
                .distinct()
            )

        def side(name: str) -> DataFrame:
            return sigs.select(F.col("id").alias(name), F.col("sig").alias(f"s{name}"))

        close = estimate(F.col("sa"), F.col("sb"), bands * rows) >= least_estimate
        stars = members.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
        tried = scratch.write(stars.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b"), "tried")
        found = scratch.write(confirm(tried), "found")
        groups = scratch.write(connected_components(found, scratch), "groups")

        placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("component")
        )
        placed = scratch.write(placed, "placed")
        mixed_up = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        mixed_up = scratch.write(mixed_up.where("x <> y").select("key"), "mixed")
        open_ids = placed.join(mixed_up, "key").select("id", "component").distinct()
        sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
        open_ids = open_ids.join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        open_ids = scratch.write(open_ids.join(sigs, "id"), "open")
        open_texts = texts.join(open_ids.select("id"), "id", "left_semi")
        across = _across(open_texts, open_ids, close, percent, width, scratch)
        across = scratch.write(across.join(tried, ["a", "b"], "left_anti"), "across")
        more = scratch.write(confirm(across), "found")
        edges = same.select("a", "b").unionByName(found).unionByName(more)
        groups = connected_components(edges, scratch)
        out = sketch.select("id", "n_shingles").join(groups.withColumnRenamed("node", "id"), "id", "left")
        return scratch.result(
            out.select(
                F.col("id").alias(id_col),
                "n_shingles",
                F.coalesce("component", "id").alias("component_id"),
                F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"),
            )
        )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that are not the smallest id of their group."""
    marks = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(id_col).distinct()
    return docs.join(marks, id_col, "left_anti")
