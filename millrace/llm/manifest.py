"""A dataset manifest as a Merkle DAG, with proofs for its rows (operator 13).

Every tree has a fan-out of three: of each level, runs of three consecutive
nodes (the last run may be shorter, even one) become the hash of their digests,
until one node is left.  A tree for each source holds its rows in ascending
order; one more tree holds the subroots of the sources in their order.

1. Rows are numbered by one range sort: the place in a range plus the rows of
   the ranges before it, so that a source of any size is spread.
2. Nodes of `LEVELS` levels are hashed together: 3 ** LEVELS consecutive nodes
   of a tree meet in one row, which becomes one record, keyed by the digest of
   its topmost node and holding all digests below it.  Records are
   content-addressed: equal ones are stored once.  Tier after tier, until each
   tree has one node; a tier is 3 ** -LEVELS the size of the one before.
3. Leaf requests go the other way.  The distinct records that they need are
   found by the digits of their ranks; from the root down, each request joins
   the record of its digest, follows the digits, and collects the children that
   were not selected, split at the chosen one.  What is common to the requests
   below a record is collected once, not for every leaf.
4. A leaf's segments reversed are its proof: folding the leaf with them from
   the bottom up gives the root again.

Defined results: each null field counts as `-`; rows with the same id are
ordered by leaf digest, equal rows are leaves of their own; a null id or source
comes first; an empty table has no rows, no subroot and no root.  A proof of a
single row in a single source is empty.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAN = 3
#: levels in one record: a record has up to 3 ** 6 = 729 leaves (about 70 kB)
LEVELS = 6
PATH = "array<struct<left:string,right:string>>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, a colon and the value in decimal or as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with `at`, the place of each in the order (from 0); equal rows may stand in any order."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # cuts a run of equal rows into ranges
    placed = tied.orderBy(*order, "_tie").drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    placed = scratch.write(placed, name)
    range_, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["r"]: r["n"] for r in placed.groupBy(range_.alias("r")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0  # a number for each range of the sort
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    offsets = placed.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range long, _before long")
    at = placed.withColumn("_range", range_).join(F.broadcast(offsets), "_range")
    return at.withColumn("at", F.col("_before") + place).drop("_id", "_range", "_before")


def _widths(n: int, height: int) -> list[int]:
    """Nodes of each level of a record, from the lowest."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // FAN))
    return out


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _records(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, n, idx, digest) of one tier -> (tree, n, idx, digest, width, below), one row for each record.

    `n` counts the tree's nodes on the lowest level of the tier, `below` holds
    the record's digests level by level from the lowest, the topmost left out.
    """

    def run(batches):
        for batch in batches:
            out = []
            for at, n in enumerate(batch.column("n").to_pylist()):
                group = batch.column("g").slice(at, 1).flatten()
                level, below = group.field("digest").to_pylist(), []
                for _ in range(min(levels, depth(n))):
                    below += level
                    level = [_hash("".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]
                out.append((level[0], len(group), below))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree"),
                    batch.column("n"),
                    batch.column("idx"),
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.list_(pa.string())),
                ],
                names=["tree", "n", "idx", "digest", "width", "below"],
            )

    span = F.floor(F.col("idx") / F.lit(FAN**levels)).cast("long").alias("_record")
    groups = nodes.groupBy("tree", "n", span).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("g"))
    groups = groups.select("tree", "n", F.col("_record").alias("idx"), "g")
    return groups.mapInArrow(run, "tree long, n long, idx long, digest string, width int, below array<string>")


@dataclass
class Forest:
    """Records of all tiers, lowest first, as (digest, width, below); `tops` (tree, n, digest); `most` leaves of a tree."""

    store: list[DataFrame]
    tops: DataFrame
    most: int
    levels: int


def build(leaves: DataFrame, scratch: Scratch, name: str, levels: int = LEVELS) -> Forest:
    """leaves (tree, n, idx, digest): node idx of the n leaves of a tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    whole, store, tops, nodes, width = FAN**levels, [], [], leaves, most
    counts = leaves.select("tree", F.col("n").alias("leaves")).where("idx = 0")
    while True:
        made = scratch.write(_records(nodes, levels), f"{name}-made{len(store)}")
        store.append(
            scratch.write(made.select("digest", "width", "below").dropDuplicates(["digest"]), f"{name}-store{len(store)}")
        )
        tops.append(made.where(F.col("n") <= whole).select("tree", "digest"))
        if width <= whole:
            break
        up = F.ceil(F.col("n") / F.lit(whole)).cast("long")
        nodes, width = made.where(F.col("n") > whole).select("tree", up.alias("n"), "idx", "digest"), -(-width // whole)
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    tops = scratch.write(found.join(counts, "tree").select("tree", F.col("leaves").alias("n"), "digest"), f"{name}-tops")
    return Forest(store, tops, most, levels)


def _segments(below: list[str], width: int, height: int, slot: int) -> list[tuple[str, str]]:
    """Children not selected on the way to leaf `slot` of a record, topmost level first, before and after the chosen one."""
    starts, at = [], 0
    for w in _widths(width, height)[:height]:
        starts.append((at, w))
        at += w
    out = []
    for level in range(height - 1, -1, -1):
        chosen = slot // FAN**level  # the digits of the rank down to this level
        (at, w), run = starts[level], chosen - chosen % FAN
        end = min(run + FAN, w)
        out.append(("".join(below[at + run : at + chosen]), "".join(below[at + chosen + 1 : at + end])))
    return out


def descend(forest: Forest, requests: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """requests (tree, idx, ...) for leaves -> (tree, record, digest, width, below, height, path): the
    lowest records that they need, with what was collected from the root to them.

    Goes from the root down; on the way a request stands for all leaves below
    a record.  `path` of a tree's topmost record is empty.
    """
    whole, levels, tiers = FAN**forest.levels, forest.levels, len(forest.store)
    below_tier = [FAN ** (levels * (t + 1)) for t in range(tiers)]
    wanted = requests.select("tree", F.floor(F.col("idx") / below_tier[0]).cast("long").alias("record")).distinct()
    wanted = scratch.write(wanted, f"{name}-wanted")
    blank = F.array().cast(PATH).alias("path")
    height = "case " + " ".join(f"when n <= {FAN**h} then {h}" for h in range(levels + 1)) + f" else {levels} end"
    counts = forest.tops.select("tree", F.col("n").alias("leaves"))
    at = None
    for tier in range(tiers - 1, -1, -1):
        lowest = FAN ** (levels * tier)  # leaves below a node of this tier's lowest level
        n = F.ceil(F.col("leaves") / F.lit(lowest)).cast("long")
        reach = forest.tops.where(F.col("n") > (0 if tier == 0 else lowest)).where(F.col("n") <= below_tier[tier])
        tops = reach.select("tree", F.lit(0).cast("long").alias("record"), "digest", blank)
        now = tops if at is None else at.unionByName(tops)
        if tier == 0:
            now = now.join(wanted, ["tree", "record"], "left_semi")
        else:
            need = F.floor(F.col("record") / F.lit(whole**tier)).cast("long").alias("record")
            now = now.join(wanted.select("tree", need).distinct(), ["tree", "record"], "left_semi")
        now = now.join(counts, "tree").withColumn("n", n).withColumn("height", F.expr(height)).drop("leaves", "n")
        now = scratch.write(now.join(forest.store[tier], "digest"), f"{name}-at{tier}")
        if tier == 0:
            return now

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    base = row["record"] * whole
                    fresh = [
                        {
                            "tree": row["tree"],
                            "record": base + slot,
                            "digest": row["below"][slot],
                            "path": row["path"]
                            + [{"left": a, "right": b} for a, b in _segments(row["below"], row["width"], row["height"], slot)],
                        }
                        for slot in range(row["width"])
                    ]
                    yield pa.RecordBatch.from_pylist(fresh, schema)

        schema = pa.schema(
            [
                ("tree", pa.int64()),
                ("record", pa.int64()),
                ("digest", pa.string()),
                ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
            ]
        )
        at = now.mapInArrow(run, f"tree long, record long, digest string, path {PATH}")


def prove(found: DataFrame, requests: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs for requests (tree, idx, key, leaf, claim): (key, leaf, subroot, proof_sha256, folded_root).

    `found` comes from `descend`, `above` (tree, subroot, over) has each tree's
    root and the path over it.  A claim that is not null is folded in place of the leaf.
    """
    record = F.floor(F.col("idx") / F.lit(FAN**levels)).cast("long").alias("record")
    each = F.struct((F.col("idx") % FAN**levels).cast("int").alias("slot"), "key", "leaf", "claim")
    asked = requests.groupBy("tree", record).agg(F.collect_list(each).alias("asked"))
    rows = asked.join(found, ["tree", "record"]).join(above, "tree")
    rows = rows.select("subroot", "asked", "width", "below", "height", F.concat("over", "path").alias("path"))

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1).drop_columns(["asked"]).to_pylist()[0]
                asked = whole.column("asked").slice(i, 1).flatten()
                upper = [(p["left"], p["right"]) for p in row["path"]]
                over = "".join(a + b for a, b in reversed(upper))
                proofs, roots = [], []
                parts = [asked.field(c).to_pylist() for c in ("slot", "leaf", "claim")]
                for slot, leaf, claim in zip(*parts):
                    path = _segments(row["below"], row["width"], row["height"], slot)
                    path.reverse()
                    proofs.append(_hash("".join([a + b for a, b in path]) + over))
                    digest = claim or leaf
                    for a, b in path:
                        digest = _hash(a + digest + b)
                    for a, b in reversed(upper):
                        digest = _hash(a + digest + b)
                    roots.append(digest)
                yield pa.RecordBatch.from_arrays(
                    [
                        asked.field("key"),
                        asked.field("leaf"),
                        pa.array([row["subroot"]] * len(asked), pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(roots, pa.string()),
                    ],
                    names=["key", "leaf", "subroot", "proof_sha256", "folded_root"],
                )

    kind = requests.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")


def manifest(
    rows: DataFrame, fields: list[str], id_col: str, source_col: str, altered: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row.

    The leaf hashes `fields`.  `altered` replaces fields of a row for the check
    only: the folded root is that of the altered leaf with the original proof.
    """
    spark = rows.sparkSession
    here = [F.col(f"`{c}`") for c in fields]
    there = [(altered or {}).get(c, F.col(f"`{c}`")) for c in fields]
    claim = leaf_digest(*there) if altered else F.lit(None).cast("string")
    leaves = rows.select(
        F.col(f"`{id_col}`").alias("key"), F.col(f"`{source_col}`").alias("source"), leaf_digest(*here).alias("leaf"),
        claim.alias("claim"),
    )
    with Scratch(spark) as scratch:
        leaves = scratch.write(leaves, "leaves")
        placed = numbered(leaves, ["source", "key", "leaf"], scratch, "placed")
        sizes = placed.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("n"))
        sources = scratch.write(numbered(sizes, ["start"], scratch, "sizes").withColumnRenamed("at", "tree"), "sources")
        keyed = placed.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        nodes = keyed.select("tree", "n", (F.col("at") - F.col("start")).alias("idx"), "key", "leaf", "claim")
        nodes = scratch.write(nodes, "nodes")

        lower = build(nodes.select("tree", "n", "idx", F.col("leaf").alias("digest")), scratch, "lower", levels)
        many = lower.tops.count()
        subroots = lower.tops.select(
            F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"
        )
        subroots = scratch.write(subroots, "subroots")
        upper = build(subroots, scratch, "upper", levels)
        top = upper.tops.select("digest").first()
        root = top["digest"] if top else None

        asked = subroots.select("tree", "idx", F.col("idx").alias("key"), "digest")
        over = _over(descend(upper, asked, scratch, "upper"), asked, levels)
        over = scratch.write(over, "over")
        found = descend(lower, nodes, scratch, "lower")
        proofs = prove(found, nodes, over, levels)
        return scratch.result(
            proofs.select(
                F.col("key").alias(id_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"),
                "proof_sha256", "folded_root", F.col("folded_root").eqNullSafe(F.lit(root)).alias("verified"),
            )
        )


def _over(found: DataFrame, asked: DataFrame, levels: int) -> DataFrame:
    """(tree, subroot, over): each source's subroot and the path from the root to it, topmost first."""
    record = F.floor(F.col("idx") / F.lit(FAN**levels)).cast("long").alias("record")
    rows = asked.select("tree", record, (F.col("idx") % FAN**levels).cast("int").alias("slot"), "key", F.col("digest").alias("subroot"))
    rows = rows.groupBy("tree", "record").agg(F.collect_list(F.struct("slot", "key", "subroot")).alias("asked"))
    rows = rows.join(found, ["tree", "record"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row, out = batch.slice(i, 1).to_pylist()[0], []
                for a in row["asked"]:
                    path = _segments(row["below"], row["width"], row["height"], a["slot"])
                    out.append({"tree": a["key"], "subroot": a["subroot"], "over": row["path"] + [{"left": x, "right": y} for x, y in path]})
                yield pa.RecordBatch.from_pylist(out, schema)

    pair = pa.struct([("left", pa.string()), ("right", pa.string())])
    schema = pa.schema([("tree", pa.int64()), ("subroot", pa.string()), ("over", pa.list_(pair))])
    return rows.mapInArrow(run, f"tree long, subroot string, over {PATH}")
