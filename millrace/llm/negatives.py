"""Hard negatives by threshold joins over a pruned inverted index (operator 11).

Vectors are whole numbers and a score is their exact inner product.  For each
anchor: its best `positives` rows of the same label; for each of them the best
`negatives` rows of another label whose score lies in a window below the
positive's score.

1. Rows are dealt to blocks of about `block_rows` rows at most that are near the
   same pivot, so that a block has a centre and a radius: blocks of one label for
   the positives, of any labels for the negatives.  A label or a spot that holds
   a third of all rows is many blocks.
2. A round has a threshold for each anchor.  An anchor is sent to the blocks
   where <anchor, centre> + |anchor| * radius reaches it, in batches of bounded
   size; no pair of rows is formed.
3. In a block, dimensions are taken in order of their energy.  A row is entered
   in the inverted index only up to the dimension from which the norm of what
   is left, times the largest such norm of the anchors, is below the lowest
   threshold: a pair that meets only there cannot reach it.  Partial scores are
   accumulated list by list, and a pair is pruned as soon as its partial score
   plus the product of both remaining norms falls below the anchor's threshold.
   Pairs that survive get their exact score from the rows.
4. Thresholds start high and are lowered, in steps, for those anchors only whose
   positives or windows are not full yet, down to the window's lower end (for
   positives: to no threshold at all).  Everything at or above the threshold has
   been seen, so what is full is final.  No step drops a row.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; so do rows whose scaled norm reaches 2**31,
because scores have to fit a long; vectors of different lengths have no score;
of rows with the same id the one with the smallest label, then vector counts;
ties go to the smaller id; an anchor without positives, and a window without
rows, has no result.  Ids and labels keep their type.  Other columns are not
looked at.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .text import list_column

SCALE = 256
#: parts of an anchor's norm times the largest norm, tried for positives before the end (no threshold)
POSITIVE_STEPS = (0.8, 0.4, 0.25)
#: parts of a window, from its upper end to its lower one
WINDOW_STEPS = (0.3, 0.6, 1.0)


def whole_vectors(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """(id, label, v array<bigint>): valid rows, one for each id, floor(SCALE * x) of each component."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null")
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda s, x: s + (SCALE * F.abs(x) + 1) * (SCALE * F.abs(x) + 1))
    rows = rows.where(finite & (norm < float(1 << 62)))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r"))
    return one.select("id", "r.label", F.transform("r.x", lambda x: F.floor(SCALE * x).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows; by Cauchy-Schwarz no partial sum leaves 53 bits where doubles are used."""
    x, y = a.astype(float), b.astype(float)
    most = math.sqrt((x * x).sum(axis=1).max(initial=0)) * math.sqrt((y * y).sum(axis=1).max(initial=0))
    return (x @ y.T).astype(np.int64) if most < 1 << 52 else a @ b.T


def threshold_join(anchors: np.ndarray, rows: np.ndarray, thresholds: np.ndarray, step: int = 8):
    """(anchor, row, score) of all pairs of whole vectors whose inner product is at least the anchor's threshold."""
    n, dim = rows.shape
    y, x = rows.astype(float), anchors.astype(float)
    order = np.argsort(-(y * y).sum(axis=0), kind="stable")
    y, x = y[:, order], x[:, order]
    # norms of what is left from each dimension on; a little more, so that rounding never prunes
    left_y = np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    left_x = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]) * (1 + 1e-9)
    left_y, left_x = np.pad(left_y, ((0, 0), (0, 1))), np.pad(left_x, ((0, 0), (0, 1)))
    lowest = thresholds.min(initial=np.inf)
    # a row is indexed up to the first dimension from which no anchor can reach the lowest threshold
    reach = left_y * left_x.max(axis=0, initial=0)[None, :]
    indexed = np.where((reach < lowest).any(axis=1), (reach < lowest).argmax(axis=1), dim)
    live = np.ones((len(x), n), bool)
    live[:, indexed == 0] = lowest <= 0
    partial = np.zeros((len(x), n))
    for at in range(0, dim, step):
        end = min(at + step, dim)
        # postings of these dimensions: rows that are indexed this far and still live for some anchor
        listed = np.flatnonzero((indexed > at) & live.any(axis=0))
        asking = np.flatnonzero(live.any(axis=1))
        if not len(listed) or not len(asking):
            break
        inside = np.arange(at, end)[None, :] < indexed[listed, None]
        grid = np.ix_(asking, listed)
        partial[grid] += x[asking, at:end] @ (y[listed, at:end] * inside).T
        # what is left of a row: its unindexed dimensions, or those after this step
        rest = np.minimum(end, indexed[listed])
        bound = partial[grid] + left_x[asking][:, rest] * left_y[listed, rest][None, :]
        slack = 1e-9 * (left_x[asking, 0][:, None] * left_y[listed, 0][None, :] + 1)
        live[grid] &= bound + slack >= thresholds[asking, None]
    a, r = np.nonzero(live)
    if len(a) * 4 > live.size:
        scores = _products(anchors, rows)[a, r]
    else:
        scores = np.empty(len(a), np.int64)
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            scores[part] = (anchors[a[part]] * rows[r[part]]).sum(axis=1)
    found = scores >= thresholds[a]
    return a[found], r[found], scores[found]


def _pivots(rows: DataFrame, pivots: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Unit vectors that rows are dealt by, for each length of vectors: chosen farthest apart from a bounded sample."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    out = {}
    for dim in {len(r["v"]) for r in sample}:
        mine = [r["v"] for r in sample if len(r["v"]) == dim]
        x = np.array(mine, float).reshape(len(mine), dim)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        chosen, far = [0], 1 - x @ x[0]
        while len(chosen) < min(pivots, len(x)) and far.max(initial=0) > 1e-3:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 1 - x @ x[chosen[-1]])
        out[dim] = x[chosen]
    return out


def _wider(rows: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in added.items()]])


def _cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with `dim` and `cell`, the nearest pivot."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                sizes = batch.column("dim").to_numpy()
                cell = np.zeros(batch.num_rows, np.int32)
                for dim in np.unique(sizes):
                    if dim in pivots:
                        mine = np.flatnonzero(sizes == dim)
                        x = _matrix(batch.column("v").take(pa.array(mine)), int(dim))
                        cell[mine] = (x.astype(float) @ pivots[dim].T).argmax(axis=1)
                yield batch.append_column("cell", pa.array(cell))

    plain = rows.withColumn("dim", F.size("v"))
    return plain.mapInArrow(run, _wider(plain, cell=T.IntegerType()))


def _blocks(cells: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """(block, keys, ids, labels, flat, centre, radius): at most about block_rows rows that agree in the
    keys and the cell, their vectors one after the other, in ascending order of ids."""
    sizes = cells.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("parts")
    placed = cells.join(sizes.select(*keys, "cell", parts), [*keys, "cell"])
    block = F.xxhash64(*keys, "cell", F.pmod(F.xxhash64("id"), "parts"))
    row = F.struct("id", F.col("label").alias("own"), "v")
    packed = placed.withColumn("block", block).groupBy("block", *keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                batch = whole.slice(i, 1)
                rows = batch.column("rows").flatten()
                v = rows.field("v")
                x = _matrix(v, len(v[0])).astype(float)
                centre = x.mean(axis=0)
                one = [list_column(centre, [len(centre)]), pa.array([np.sqrt(((x - centre) ** 2).sum(axis=1).max())])]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                         for c in (rows.field("id"), rows.field("own"), v.flatten())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.drop_columns(["rows"]).columns, *lists, *one], names=[*names, "ids", "labels", "flat", "centre", "radius"]
                )

    names = packed.columns[:-1]
    ids, labels = (T.ArrayType(cells.schema[c].dataType) for c in ("id", "label"))
    vector = T.ArrayType(T.DoubleType())
    schema = _wider(packed.drop("rows"), ids=ids, labels=labels, flat=T.ArrayType(T.LongType()), centre=vector, radius=T.DoubleType())
    return packed.mapInArrow(run, schema)


def _visits(asking: DataFrame, blocks: DataFrame, keys: list[str], batch_rows: int) -> DataFrame:
    """asking (id, label, dim, v, threshold, windows) -> (block, asked): anchors that may find something in a block.

    Anchors and outlines of blocks meet as matrices, some hundred of each: the
    stated query set against all blocks, not rows.
    """
    parts = max(1, math.ceil(asking.count() / batch_rows))
    slabs = max(1, math.ceil(blocks.count() / batch_rows))
    ask = F.struct("id", "label", "v", "threshold", "windows")
    dealt = asking.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    asked = dealt.groupBy(*keys, "part").agg(F.collect_list(ask).alias("asked"))
    outline = blocks.withColumn("slab", F.pmod(F.xxhash64("block"), F.lit(slabs))).groupBy(*keys, "slab")
    outline = outline.agg(F.collect_list(F.struct("block", "centre", "radius")).alias("blocks"))
    every = asked.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    met = every.join(outline, [*keys, "slab"]).select("dim", "asked", "blocks")

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                dim = whole.column("dim")[i].as_py()
                asked = whole.column("asked").slice(i, 1).flatten()
                there = whole.column("blocks").slice(i, 1).flatten()
                x = _matrix(asked.field("v"), dim).astype(float)
                centre, radius = _matrix(there.field("centre"), dim), there.field("radius").to_numpy()
                norms = np.sqrt((x * x).sum(axis=1))
                wide = radius + np.sqrt((centre * centre).sum(axis=1))
                most = x @ centre.T + norms[:, None] * radius[None, :] + 1e-9 * (norms[:, None] * wide[None, :] + 1)
                reach = most >= asked.field("threshold").to_numpy()[:, None]
                for j in np.flatnonzero(reach.any(axis=0)):
                    chosen = asked.take(pa.array(np.flatnonzero(reach[:, j])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            there.field("block").slice(int(j), 1),
                            pa.ListArray.from_arrays(pa.array([0, len(chosen)], pa.int32()), chosen),
                        ],
                        names=["block", "asked"],
                    )

    return met.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), asked.schema["asked"]]))


def _search(visits: DataFrame, blocks: DataFrame, best: int, same: bool) -> DataFrame:
    """(anchor, key, id, score): of each anchor, window and block the `best` rows of the same or of other labels.

    A window is (key, lo, hi), both ends included, and lies at or above the anchor's threshold.
    """
    rows = visits.join(blocks.select("block", "dim", "ids", "labels", "flat"), "block")

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                dim = whole.column("dim")[i].as_py()
                asked = whole.column("asked").slice(i, 1).flatten()
                ids = whole.column("ids").slice(i, 1).flatten()
                codes = pa.concat_arrays([whole.column("labels").slice(i, 1).flatten(), asked.field("label")])
                codes = codes.dictionary_encode().indices.to_numpy()
                x = _matrix(asked.field("v"), dim)
                y = whole.column("flat").slice(i, 1).flatten().to_numpy().reshape(len(ids), dim)
                a, r, score = threshold_join(x, y, asked.field("threshold").to_numpy())
                mine = (codes[len(ids) + a] == codes[r]) == same
                a, r, score = a[mine], r[mine], score[mine]
                # ids ascend in a block: ties keep the smaller id first
                order = np.lexsort((r, -score, a))
                a, r, score = a[order], r[order], score[order]
                cuts = np.searchsorted(a, np.arange(len(asked) + 1))
                own, windows = asked.field("id"), asked.field("windows").to_pylist()
                anchors, found, keys = [], [], []
                for k in range(len(asked)):
                    s = score[cuts[k] : cuts[k + 1]]
                    for w in windows[k]:
                        begin, end = np.searchsorted(-s, -w["hi"], "left"), np.searchsorted(-s, -w["lo"], "right")
                        n = max(0, min(end, begin + best) - begin)
                        anchors += [k] * n
                        keys += [w["key"]] * n
                        found += range(cuts[k] + begin, cuts[k] + begin + n)
                found = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(anchors, pa.int64())), pa.array(keys, own.type), ids.take(pa.array(r[found])),
                     pa.array(score[found])],
                    names=["anchor", "key", "id", "score"],
                )

    kind = visits.schema["asked"].dataType.elementType["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"anchor {kind}, key {kind}, id {kind}, score long")


def _first(found: DataFrame, keys: list[str], best: int) -> DataFrame:
    """The best rows of each group with their rank; Spark cuts the groups before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _part(value: str, share: tuple[int, int], up: bool) -> Column:
    """value * share[0] / share[1] of a long that is not negative, rounded, without leaving the long."""
    a, b = share
    return F.expr(f"{a} * ({value} div {b}) + ({a} * ({value} % {b}) + {b - 1 if up else 0}) div {b}")


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    least: tuple[int, int] = (50, 100),
    most: tuple[int, int] = (95, 100),
    block_rows: int = 2048,
    pivots: int = 64,
    sample_rows: int = 5000,
    batch_rows: int = 512,
) -> DataFrame:
    """rows (id, label, v) of `whole_vectors` -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` says which rows are anchors.  A negative's score is at least least[0] / least[1]
    and at most most[0] / most[1] of the positive's; positives of a negative score have none.
    There are at most `pivots` pivots, one for eight blocks, from a sample of `sample_rows`;
    they decide what is near, not what is found.
    """
    kind = rows.schema["id"].dataType.simpleString()
    with Scratch(rows.sparkSession) as scratch:
        rows = scratch.write(rows, "rows")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        n, longest = rows.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
        near = _pivots(rows, min(pivots, math.ceil(n / (8 * block_rows))), sample_rows)
        cells = scratch.write(_cells(rows, near), "cells")
        anchors = scratch.write(rows.where(anchor).withColumn("dim", F.size("v")).withColumn("norm", norm), "anchors")

        blocks = scratch.write(_blocks(cells, ["dim", "label"], block_rows), "alike")
        ends = [F.lit(None).cast(kind).alias("key")]
        ends += [F.lit(end).cast("long").alias(name) for name, end in (("lo", -(1 << 62)), ("hi", 1 << 62))]
        todo, full = anchors, []
        for turn, part in enumerate((*POSITIVE_STEPS, None)):
            threshold = F.lit(float("-inf")) if part is None else part * longest * F.col("norm")
            asking = todo.withColumn("threshold", threshold).withColumn("windows", F.array(F.struct(*ends)))
            visits = _visits(asking, blocks, ["dim", "label"], batch_rows)
            # one more than wanted, because an anchor finds itself
            found = _search(visits, blocks, positives + 1, same=True).where("anchor <> id")
            found = scratch.write(_first(found, ["anchor"], positives), f"positives{turn}")
            if part is None:
                full.append(found)
                break
            done = found.where(F.col("rank") == positives).select("anchor")
            full.append(found.join(done, "anchor", "left_semi"))
            todo = scratch.write(todo.join(done, todo["id"] == done["anchor"], "left_anti"), f"todo{turn}")
            if todo.isEmpty():
                break
        pairs = reduce(DataFrame.unionByName, full).where("score >= 0")
        pairs = pairs.select(
            "anchor", F.col("id").alias("key"), F.col("score").alias("positive_score"),
            _part("score", least, True).alias("lo"), _part("score", most, False).alias("hi"),
        )
        open_ = pairs = scratch.write(pairs, "pairs")

        blocks, out = scratch.write(_blocks(cells, ["dim"], block_rows), "all"), []
        for turn, part in enumerate(WINDOW_STEPS):
            reach = F.col("lo") if part >= 1 else F.col("hi") - F.floor((F.col("hi") - F.col("lo")) * part)
            windows = open_.withColumn("reach", reach.cast("long")).groupBy("anchor").agg(
                # a little below the lowest end, which a double may not hold
                (F.min("reach").cast("double") * (1 - 1e-12) - 1).alias("threshold"),
                F.array_sort(F.collect_list(F.struct("key", F.col("reach").alias("lo"), "hi"))).alias("windows"),
            )
            asking = scratch.write(anchors.join(windows, anchors["id"] == windows["anchor"]), f"asking{turn}")
            found = _search(_visits(asking, blocks, ["dim"], batch_rows), blocks, negatives, same=False)
            found = scratch.write(_first(found, ["anchor", "key"], negatives), f"negatives{turn}")
            if part >= 1:
                out.append(found)
                break
            done = found.where(F.col("rank") == negatives).select("anchor", "key")
            out.append(found.join(done, ["anchor", "key"], "left_semi"))
            open_ = scratch.write(open_.join(done, ["anchor", "key"], "left_anti"), f"open{turn}")
            if open_.isEmpty():
                break
        found = reduce(DataFrame.unionByName, out).join(pairs.select("anchor", "key", "positive_score"), ["anchor", "key"])
        return scratch.result(
            found.select(
                F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
            )
        )
