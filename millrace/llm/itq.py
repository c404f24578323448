"""Near-duplicate vectors by iterative quantisation (operator 10).

1. Rotations of the principal axes are learned on a bounded sample so that
   signs give balanced codes with little loss.  Codes are cut into substrings,
   one for each table; vectors meet where a substring is equal (multi-index
   Hamming tables).
2. Length and number of the substrings follow the data (`plan`): for each length
   the sample tells how many tables find 97 % of its own links and of pairs made
   at exactly the linking cosine, and how many random pairs would meet; the
   cheapest for the number of vectors is taken.  Centred codes lose little where
   vectors point everywhere; where they share a direction, and nearly all are
   linked, the plan ends at shorter substrings, at last at none: then all meet
   all, in blocks, and nothing is lost.  Longer tables have longer substrings and
   more tables, so meetings grow little faster than the vectors.
3. Balls: vectors within half the linking angle of a leader are all linked with
   each other, by the triangle inequality on the sphere.  Their links are
   counted, not formed, so a large group of copies costs its size.
4. Vectors of different balls that meet are reranked with the original vectors
   in double precision, block by block: a block of rows of one key gives the
   number of links of each row and a few links that keep its groups connected,
   never its pairs.  A pair counts in the first table where it meets.  Blocks
   have a bounded number of rows; of the largest ball of a key only the pairs
   with others are looked at.

Recall, measured in tests: at least 0.9 on vectors that point everywhere, that
share a direction, that form clusters, and that lie in few dimensions.

Defined results: vectors that are null, empty, zero or hold null or non-finite
numbers link with nothing; vectors of different lengths never link; a null id
links with nothing, has a null component and is kept; of rows with the same id
the smallest vector (as arrays compare) counts, for all of them.  Ids keep
their type.  Rotations are learned for lengths up to `MOST_NUMBERS` that the
sample holds `FEW` times; other lengths use random hyperplanes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .text import list_column

#: lengths of vectors for which rotations are learned, and how often the sample must hold one
MOST_NUMBERS, FEW = 1024, 64
#: share of calibration pairs that must meet, longest substring, most bits of a code
TARGET, MOST_BITS, CODE_BITS = 0.97, 24, 1024
#: cost of one more copy of a vector in a table, in cosines
COPY_COST = 500
#: rows of a block
LEFT_ROWS, RIGHT_ROWS = 512, 2048
#: tables that look for balls
BALL_TABLES = 4


def learn(sample: np.ndarray, rounds: int = 50, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) so that signs of (x - mean) @ projection are the code."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(64, sample.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (left @ right).T
    return mean, axes @ rotation


@dataclass
class Plan:
    """Codes of vectors of one length: signs of (x - mean) @ planes, in `tables` substrings of `size` bits."""

    mean: np.ndarray
    planes: np.ndarray
    size: int
    tables: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.planes[:, : self.size * self.tables] >= 0).astype(np.int64)
        shift = np.left_shift(np.int64(1), np.arange(self.size, dtype=np.int64))
        return (bits.reshape(len(x), self.tables, self.size) * shift).sum(axis=2)


def _pairs_for(x: np.ndarray, least: float, half: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of vectors that have to meet: links of the sample below the angle of a ball, and pairs at exactly `least`."""
    rng, some = np.random.default_rng(seed), x[:1500]
    a, b = np.nonzero(np.triu(some @ some.T >= least, 1))
    far = (some[a] * some[b]).sum(axis=1) < half
    a, b = a[far], b[far]
    chosen = rng.permutation(len(a))[:3000]
    out = [(some[a[chosen]], some[b[chosen]])] if len(chosen) >= 30 else []
    base = x[rng.integers(len(x), size=1500)]
    away = x[rng.integers(len(x), size=1500)] - x[rng.integers(len(x), size=1500)]
    away -= (away * base).sum(axis=1, keepdims=True) * base
    norm = np.linalg.norm(away, axis=1)
    good = norm > 1e-6
    if good.any():
        side = away[good] / norm[good, None]
        out.append((base[good], least * base[good] + math.sqrt(1 - least * least) * side))
    return out


def plan(sample: np.ndarray, n: int, least: float, seed: int = 3) -> Plan:
    """The cheapest codes for n vectors (rows of the sample have unit length)."""
    half = math.sqrt((1 + least) / 2)
    dim = sample.shape[1]
    pairs, best, price = _pairs_for(sample, least, half), Plan(np.zeros(dim), np.zeros((dim, 0)), 0, 1), COPY_COST * n + n * n / 2
    mean, planes, width = None, [], 0
    while width < CODE_BITS:
        mean, more = learn(sample, 50 if not planes else 5, seed + len(planes))
        planes.append(more)
        width += more.shape[1]
    planes, some = np.concatenate(planes, axis=1)[:, :CODE_BITS], sample[:1500]
    for centre in (mean, np.zeros(dim)):
        bits = (some - centre) @ planes >= 0
        apart = [((a - centre) @ planes >= 0) != ((b - centre) @ planes >= 0) for a, b in pairs]
        for size in range(1, MOST_BITS + 1):
            tables = width // size
            found = [_first_meeting(d, size, tables) for d in apart]
            need = max((int(np.quantile(f, TARGET, method="higher")) + 1 for f in found), default=1)
            if need > tables:
                continue
            met = 0.0
            for t in range(need):
                _, counts = np.unique(bits[:, t * size : (t + 1) * size], axis=0, return_counts=True)
                met += (counts * (counts - 1)).sum() / max(1, len(some) * (len(some) - 1))
            cost = COPY_COST * n * need + n * n / 2 * met
            if cost < price:
                best, price = Plan(centre, planes[:, : size * need], size, need), cost
    return best


def _first_meeting(apart: np.ndarray, size: int, tables: int) -> np.ndarray:
    """The first table in which each pair has equal substrings, or `tables`."""
    equal = ~apart[:, : size * tables].reshape(len(apart), tables, size).any(axis=2)
    return np.where(equal.any(axis=1), equal.argmax(axis=1), tables)


def _untrained(n: int, least: float) -> tuple[int, int]:
    """(bits of a substring, tables) for random hyperplanes, where nothing is known of the vectors."""
    same, options = 1 - math.acos(least) / math.pi, [(COPY_COST * n + n * n / 2, 0, 1)]
    for size in range(1, MOST_BITS + 1):
        tables = math.ceil(math.log(1 - TARGET) / math.log(1 - same**size))
        options.append((COPY_COST * n * tables + n * n / 2 * tables / 2**size, size, tables))
    return min(options)[1:]


def _unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    x = lists.flatten().to_numpy().reshape(len(lists), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows (id, v) that can link: one for each id, finite and not zero."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    some = F.exists("v", lambda x: F.abs(x) > 0)
    one = vectors.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    return one.where(finite & some)


def plans(valid: DataFrame, least: float, sample_rows: int) -> dict[int, Plan]:
    """Plans of the lengths that a sample of at most sample_rows vectors, the first by a hash of the id, holds often."""
    short = valid.where(F.size("v") <= MOST_NUMBERS)
    lists = short.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    often = [int(d) for d in np.unique(sizes) if (sizes == d).sum() >= FEW]
    n = {r["dim"]: r["n"] for r in short.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    # no more than MOST_NUMBERS lengths
    return {d: plan(_unit_rows(lists.take(pa.array(np.flatnonzero(sizes == d))), d), n[d], least) for d in often}


def codes(vectors: DataFrame, known: dict[int, Plan], untrained: tuple[int, int]) -> DataFrame:
    """(id, v) -> id, v, dim, codes array<long>: unit vectors and the substring of each table."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes = batch.column("dim").to_numpy()
                for dim in np.unique(sizes):
                    rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                    x = _unit_rows(rows.column("v"), int(dim))
                    one = known.get(int(dim))
                    if one is None:
                        size, tables = untrained
                        planes = np.random.default_rng(int(dim)).normal(size=(int(dim), size * tables))
                        one = Plan(np.zeros(int(dim)), planes, size, tables)
                    found = one.codes(x)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("id"),
                            list_column(x.ravel(), np.full(len(x), int(dim))),
                            rows.column("dim"),
                            list_column(found.ravel(), np.full(len(x), found.shape[1])),
                        ],
                        names=["id", "v", "dim", "codes"],
                    )

    rows = vectors.select("id", "v", F.size("v").alias("dim"))
    return rows.mapInArrow(run, f"id {kind}, v array<double>, dim int, codes array<long>")


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b) -> a, b, cosine, from unit vectors of equal length."""
    rows = pairs.join(vectors.select(F.col("num").alias("a"), F.col("v").alias("va")), "a")
    rows = rows.join(vectors.select(F.col("num").alias("b"), F.col("v").alias("vb")), "b")
    product = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select("a", "b", product.alias("cosine"))


def _keys(rows: DataFrame, tables: int | None = None) -> DataFrame:
    """rows (dim, codes, ...) -> one row with `table` and `key` for each of the first tables."""
    chosen = F.col("codes") if tables is None else F.slice("codes", 1, tables)
    rows = rows.select("*", F.posexplode(chosen).alias("table", "code"))
    return rows.withColumn("key", F.xxhash64("table", "dim", "code")).drop("code")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows (key, table, dim, num, ball, v, codes, parts) in blocks of about `size` rows of a key: (key, table, dim, name)."""
    part = F.pmod(F.xxhash64("num"), F.ceil(F.col("n") / F.lit(size)).cast("long"))
    row = F.struct("num", "ball", "minor", "v", "codes")
    packed = rows.groupBy("key", "table", "dim", part.alias("part")).agg(F.collect_list(row).alias(name))
    return packed.select("key", "table", "dim", name)


def _linked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least row that each row and each column of a block reaches by its pairs."""
    rows, columns = np.arange(mask.shape[0]), np.arange(mask.shape[1])
    none = mask.shape[0]
    left, right = rows.copy(), np.full(len(columns), none)
    while True:
        reached = np.where(mask, left[:, None], none).min(axis=0, initial=none)
        right, before = np.minimum(right, reached), left
        left = np.minimum(left, np.where(mask, right[None, :], none).min(axis=1, initial=none))
        if (left == before).all():
            break
    return left, right


def _rerank(meetings: DataFrame, least: float) -> DataFrame:
    """Blocks (table, dim, lefts, rights) -> (num, links, other): links of a row to rows of other balls, and
    a row that it is connected with in this block."""

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                dim, table = whole.column("dim")[i].as_py(), whole.column("table")[i].as_py()
                a, b = (whole.column(c).slice(i, 1).flatten() for c in ("lefts", "rights"))
                num, other = a.field("num").to_numpy(), b.field("num").to_numpy()
                x, y = (s.field("v").flatten().to_numpy().reshape(len(s), dim) for s in (a, b))
                mask = x @ y.T >= least
                mask &= a.field("ball").to_numpy()[:, None] != b.field("ball").to_numpy()[None, :]
                # two rows outside the key's largest ball are on both sides: once is enough
                minor = b.field("minor").to_numpy(zero_copy_only=False)
                mask &= ~minor[None, :] | (num[:, None] < other[None, :])
                if table and mask.any():
                    p, q = np.nonzero(mask)
                    here, there = (s.field("codes").flatten().to_numpy().reshape(len(s), -1)[:, :table] for s in (a, b))
                    for at in range(0, len(p), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        seen = (here[p[part]] == there[q[part]]).any(axis=1)
                        mask[p[part][seen], q[part][seen]] = False
                if not mask.any():
                    continue
                left, right = _linked(mask)
                row, column = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([num[row], other[column]])),
                        pa.array(np.concatenate([mask.sum(axis=1)[row], mask.sum(axis=0)[column]])),
                        pa.array(np.concatenate([num[left[row]], num[right[column]]])),
                    ],
                    names=["num", "links", "other"],
                )

    return meetings.mapInArrow(run, "num long, links long, other long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    sample_rows: int = 5_000,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of vectors."""
    source = vectors.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    with Scratch(vectors.sparkSession) as scratch:
        valid = scratch.write(_valid(source), "valid")
        total = valid.count()
        coded = codes(valid, plans(valid, least, sample_rows), _untrained(total, least))
        # vectors go by a number of their own
        coded = scratch.write(coded.withColumn("num", F.monotonically_increasing_id()), "coded")
        half = math.sqrt((1 + least) / 2) + 1e-9  # cosine of half the linking angle

        # balls: a vector's leader is the first of a substring that is near enough, then the leader's leader if that is
        plain = coded.select("num", "dim", "codes")
        exact = scratch.write(_keys(plain, BALL_TABLES).select("num", "key"), "exact")
        centres = exact.groupBy("key").agg(F.min("num").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        tries = exact.join(scratch.write(centres, "centres"), "key").where("num <> b").select(F.col("num").alias("a"), "b")
        near = cosines(tries.distinct(), coded).where(F.col("cosine") >= half)
        first = scratch.write(near.groupBy("a").agg(F.min("b").alias("leader")), "first")
        again = first.join(first.select(F.col("a").alias("leader"), F.col("leader").alias("b")), "leader")
        second = cosines(again.select("a", "b"), coded).where(F.col("cosine") >= half).select("a", F.col("b").alias("better"))
        balls = coded.join(first.withColumnRenamed("a", "num"), "num", "left").join(
            second.withColumnRenamed("a", "num"), "num", "left"
        )
        balls = balls.withColumn("ball", F.coalesce("better", "leader", "num")).drop("leader", "better")
        balls = scratch.write(balls, "balls")
        sizes = scratch.write(balls.groupBy("ball").agg(F.count("*").alias("size")), "ballsizes")

        # keys where several balls meet, with their largest ball; only then vectors are dealt out
        entries = scratch.write(_keys(balls.select("num", "dim", "codes", "ball")).select("num", "ball", "table", "key"), "entries")
        counts = entries.groupBy("key", "ball").agg(F.count("*").alias("m"))
        major = counts.groupBy("key").agg(
            F.max_by("ball", F.struct("m", "ball")).alias("major"), F.sum("m").alias("n"), F.max("m").alias("m"), F.count("*").alias("balls")
        )
        major = scratch.write(major.where("balls > 1").drop("balls"), "major")
        met = entries.join(major, "key").withColumn("minor", F.col("ball") != F.col("major")).drop("ball", "major")
        rows = met.join(balls.select("num", "dim", "codes", "ball", "v"), "num")
        rights = _blocks(rows, RIGHT_ROWS, "rights")
        lefts = _blocks(rows.where("minor").withColumn("n", F.col("n") - F.col("m")), LEFT_ROWS, "lefts")
        found = scratch.write(_rerank(lefts.join(rights, ["key", "table", "dim"]), least), "found")

        edges = balls.where("num <> ball").select(F.col("num").alias("a"), F.col("ball").alias("b"))
        edges = edges.unionByName(found.select(F.col("num").alias("a"), F.col("other").alias("b")))
        groups = connected_components(edges, scratch).withColumnRenamed("node", "num")
        more = found.groupBy("num").agg(F.sum("links").alias("more"))
        known = balls.select("id", "num", "ball").join(sizes, "ball").join(more, "num", "left").join(groups, "num", "left")
        links = (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
        known = scratch.write(known.select("id", links, F.coalesce("component", "num").alias("component")), "known")
        least_id = known.groupBy("component").agg(F.min("id").alias("component_id"))
        known = known.join(least_id, "component").drop("component")
        out = source.select("id").join(known, "id", "left")
        component = F.coalesce("component_id", "id")
        return scratch.result(
            out.select(
                F.col("id").alias(id_col),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                component.alias("component_id"),
                F.col("id").eqNullSafe(component).alias("kept"),
            )
        )
