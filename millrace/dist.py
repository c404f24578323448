"""Distributed order statistics: exact quantiles, prefix sums and hash-order cuts.

Spark's `percentile` keeps a value-to-count map per group and an unpartitioned
window runs in one task; both fail on a huge column.  The helpers here give the
same exact answers with bounded per-task state:

* `exact_quantiles`   narrows a bracket around each rank with sketches, then
  finishes on a bounded number of rows;
* `running_totals`    prefix sums over a total order, by range buckets and a
  small table of bucket offsets;
* `hash_cuts`         the exact md5 at given ranks, so that splits and folds
  become a plain filter with no shuffle of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SMALL_ROWS = 200_000
SKETCH_ACCURACY = 10_000
GRID = 500
BUCKET_ROWS = 50_000
#: a few hundred million distinct values; beyond that buckets grow
MAX_BUCKETS = 8192
#: rows of a task that sorts buckets
SORT_ROWS = 1_000_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def q(name: str) -> Column:
    """Column reference that survives dots and spaces in a name."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN in float columns becomes NULL."""
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


# --------------------------------------------------------------------------
# exact quantiles
# --------------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    small_rows: int = SMALL_ROWS,
    sizes: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; NULL and NaN are missing.

    Up to `small_rows` non-NULL rows one `percentile` aggregate answers
    directly.  Beyond that every (column, quantile) keeps a bracket of values
    known to hold its rank; each pass counts the rows below and inside the
    bracket and sketches the inside, which shrinks it by two to three orders
    of magnitude.  A pass is one scan with map-side combining; nothing is
    shuffled but the sketches.  `sizes` are the non-NULL counts, if known;
    columns that may hold NaN are counted here all the same.
    """
    columns, probs = list(dict.fromkeys(columns)), [float(p) for p in probs]
    if not columns:
        return {}
    df = nan_to_null(df.select(*[q(c) for c in columns]))
    kinds, sizes = dict(df.dtypes), dict(sizes or {})
    unsure = [c for c in columns if c not in sizes or kinds[c] in ("float", "double")]
    if unsure:
        counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(unsure)]).first()
        sizes |= {c: counts[f"n{i}"] for i, c in enumerate(unsure)}
    small = [c for c in columns if sizes[c] <= small_rows]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(
            *[
                F.percentile(q(c).cast("double"), F.lit(probs)).alias(f"p{i}")
                for i, c in enumerate(small)
            ]
        ).first()
        for i, c in enumerate(small):
            values = row[f"p{i}"]
            out[c] = list(values) if values is not None else [None] * len(probs)
    big = [c for c in columns if sizes[c] > small_rows]
    if big:
        out.update(_bracketed_quantiles(df, big, probs, sizes, small_rows))
    return out


class _Bracket:
    def __init__(self, column: str, prob: float, n: int):
        self.column, self.rank = column, prob * (n - 1)
        self.lo, self.hi = -math.inf, math.inf
        self.below, self.inside = 0, n

    @property
    def first(self) -> int:
        return math.floor(self.rank)

    @property
    def last(self) -> int:
        return math.ceil(self.rank)

    @property
    def closed(self) -> bool:
        return self.lo == self.hi

    def inside_value(self) -> Column:
        c = q(self.column).cast("double")
        return F.when((c >= F.lit(self.lo)) & (c <= F.lit(self.hi)), c)

    def narrow(self, grid: Sequence[float]) -> None:
        """Use sketch values at GRID+1 levels of the inside rows."""
        slack = 2.0 / SKETCH_ACCURACY
        m = max(self.inside - 1, 1)
        left = (self.first - self.below) / m - slack
        right = (self.last - self.below) / m + slack
        i, j = math.floor(left * GRID) - 1, math.ceil(right * GRID) + 1
        self.lo = max(self.lo, grid[i]) if i > 0 else max(self.lo, grid[0])
        self.hi = min(self.hi, grid[j]) if j < GRID else min(self.hi, grid[GRID])


def _bracketed_quantiles(df, columns, probs, sizes, small_rows) -> dict[str, list[float]]:
    brackets = [_Bracket(c, p, sizes[c]) for c in columns for p in probs]
    levels = [i / GRID for i in range(GRID + 1)]
    for _ in range(6):
        todo = [b for b in brackets if not b.closed and b.inside > small_rows]
        if not todo:
            break
        # brackets of one column that still coincide share a sketch
        shared = {(b.column, b.lo, b.hi): b for b in todo}
        names = {k: f"g{i}" for i, k in enumerate(shared)}
        sketches = df.agg(
            *[
                F.percentile_approx(b.inside_value(), levels, SKETCH_ACCURACY).alias(names[k])
                for k, b in shared.items()
            ]
        ).first()
        for b in todo:
            b.narrow(sketches[names[b.column, b.lo, b.hi]])
        counts = df.agg(
            *[
                e
                for i, b in enumerate(todo)
                for e in (
                    F.count(F.when(q(b.column) < F.lit(b.lo), 1)).alias(f"b{i}"),
                    F.count(b.inside_value()).alias(f"m{i}"),
                )
            ]
        ).first()
        for i, b in enumerate(todo):
            b.below, b.inside = counts[f"b{i}"], counts[f"m{i}"]
    open_ = [b for b in brackets if not b.closed]
    if open_:
        # Inside is bounded now, or holds few distinct values (heavy ties).
        row = df.agg(
            *[
                F.percentile(
                    b.inside_value(), F.lit((b.rank - b.below) / max(b.inside - 1, 1))
                ).alias(f"v{i}")
                for i, b in enumerate(open_)
            ]
        ).first()
        for i, b in enumerate(open_):
            b.lo = row[f"v{i}"]
    values = iter(brackets)
    return {c: [next(values).lo for _ in probs] for c in columns}


# --------------------------------------------------------------------------
# prefix sums over a total order
# --------------------------------------------------------------------------


def range_buckets(
    df: DataFrame, order: str, bucket: str = "_bucket", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Tag rows with a bucket number that is monotone in `order` (numeric).

    The splits come from one bounded sketch and only shape the work; they do
    not affect results.  Row counts per bucket are near even as long as
    `order` holds distinct values, so callers pre-aggregate ties.
    """
    buckets = min(MAX_BUCKETS, math.ceil(df.count() / bucket_rows))
    splits: list[float] = []
    if buckets > 1:
        levels = [i / buckets for i in range(1, buckets)]
        found = df.agg(F.percentile_approx(q(order).cast("double"), levels, SKETCH_ACCURACY).alias("s")).first()["s"]
        splits = sorted(set(found or []))
    if not splits:
        return df.withColumn(bucket, F.lit(0.0))
    cut = Bucketizer(
        splits=[-math.inf, *splits, math.inf],
        inputCol="_order_double",
        outputCol=bucket,
        handleInvalid="keep",
    )
    return cut.transform(df.withColumn("_order_double", q(order).cast("double"))).drop(
        "_order_double"
    )


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    partition: Sequence[str] = (),
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add, for every `new: source` in `totals`, the sum of `source` over rows
    strictly before this one in `order` (within `partition`).

    `df` must hold each (partition, order) key once; it is materialised, because
    the sketch, the offsets and the sums all read it.  Only a table of one row
    per bucket passes through an unpartitioned window.
    """
    from .session import cut_lineage

    part, df = list(partition), cut_lineage(df)
    tagged = range_buckets(df, order, bucket_rows=bucket_rows)
    tasks = -(-df.count() // SORT_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # a task sorts no more for a larger table
        tagged = tagged.repartition(tasks, *part, "_bucket")
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = tagged.groupBy(*part, "_bucket").agg(
        *[F.sum(q(src)).alias(f"_t_{new}") for new, src in totals.items()]
    )
    offsets = offsets.select(
        *part,
        "_bucket",
        *[
            F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}")
            for new in totals
        ],
    )
    # Without a partition the table has at most MAX_BUCKETS rows.
    side = offsets if part else F.broadcast(offsets)
    joined = tagged.join(side, [*part, "_bucket"])
    within = (
        Window.partitionBy(*part, "_bucket")
        .orderBy(q(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return joined.select(
        *[q(c) for c in df.columns],
        *[
            (F.col(f"_o_{new}") + F.coalesce(F.sum(q(src)).over(within), F.lit(0))).alias(new)
            for new, src in totals.items()
        ],
    )


def running_max(df: DataFrame, order: str, value: str, output: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the maximum of `value` over rows strictly before this one in `order`
    (NULL at the start), by the same bucket scheme as `running_totals`."""
    from .session import cut_lineage

    df = cut_lineage(df)
    tagged = range_buckets(df, order, bucket_rows=bucket_rows)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_bucket").agg(F.max(q(value)).alias("_top")).select(
        "_bucket", F.max("_top").over(before).alias("_ahead")
    )
    within = (
        Window.partitionBy("_bucket").orderBy(q(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    # greatest() skips NULLs; the offsets have at most MAX_BUCKETS rows
    return tagged.join(F.broadcast(offsets), "_bucket").select(
        *[q(c) for c in df.columns],
        F.greatest(F.col("_ahead"), F.max(q(value)).over(within)).alias(output),
    )


def value_ranks(df: DataFrame, column: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct non-NULL `value`: `n`, rows `before`, and `dense` index."""
    counts = (
        df.where(q(column).isNotNull())
        .groupBy(q(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_one", F.lit(1).cast("long"))
    )
    return running_totals(
        counts, "value", {"before": "n", "dense": "_one"}, bucket_rows=bucket_rows
    ).drop("_one")


def many_quantiles(df: DataFrame, column: str, levels: int) -> list[float]:
    """`levels` evenly spaced exact quantiles (0 … 1) of one column.

    Ranks every distinct value once.  Level i falls on rank i (n-1) / (levels-1),
    so each value computes from its own rank range which few levels can touch
    it; the cost does not grow with `levels`.
    """
    n = df.select(F.count(q(column)).alias("n")).first()["n"]
    if n == 0:
        return []
    last = levels - 1
    after = F.col("before") + F.col("n")
    scale = F.lit(last / max(n - 1, 1))
    first_level = F.greatest(F.lit(0), F.floor(F.col("before") * scale) - 1)
    last_level = F.least(F.lit(last), F.ceil(after * scale) + 1)
    exact = F.col("i") * F.lit(float(n - 1)) / F.lit(float(last))
    rows = (
        value_ranks(df, column)
        .select("value", "before", after.alias("after"), F.explode(F.sequence(first_level, last_level)).alias("i"))
        .select("value", "before", "after", F.explode(F.array(F.floor(exact), F.ceil(exact))).alias("rank"))
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("after")))
        .select("rank", F.col("value").cast("double").alias("v"))
        .distinct()
        .collect()  # at most 2 * levels rows
    )
    at = {r["rank"]: r["v"] for r in rows}
    out = []
    for i in range(levels):
        w = i * float(n - 1) / float(last)
        lo, hi = at[math.floor(w)], at[math.ceil(w)]
        out.append(lo + (hi - lo) * (w - math.floor(w)))
    return out


# --------------------------------------------------------------------------
# hash order
# --------------------------------------------------------------------------


#: digits of a hash, and how many of them a pass of `hash_cut_table` looks at
HASH_DIGITS, DIGITS = 32, 3


def hash_key(key: str | Column, seed: int) -> Column:
    """Position of a row in the seeded shuffle: md5 of 'seed:key'."""
    c = q(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_cut_table(
    df: DataFrame,
    key: str,
    seed: int,
    shares: Sequence[tuple[int, int]],
    by: str | None = None,
    rounding: str = "floor",
    small: int = BUCKET_ROWS,
) -> DataFrame:
    """(_class, _cuts array<string>): md5 values that cut the hash order of each class at exact ranks.

    `shares` holds fractions (a, b); the cut for a/b of n rows is the md5 of
    the row at 1-based rank floor or ceil(n*a/b), so `hash <= cut` keeps
    exactly that many rows when keys are unique.  A cut at rank 0 is ''.  The
    class is NULL for rows without one and where `by` is not given.

    Wanted ranks are a table of (class, hash prefix), which narrows by three
    hex digits at a time until a prefix holds at most `small` rows: a pass counts
    the rows below each open prefix, at most 4,096 counts for one, and the
    table stays a table however many classes there are.  Then only the rows
    below the last prefixes are ranked.
    """
    from .session import cut_lineage

    name = F.coalesce(F.concat(F.lit("="), q(by).cast("string")), F.lit("")) if by else F.lit("")
    base = df.select(name.alias("_g"), hash_key(key, seed).alias("_h"))
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(shares)])
    exact = F.col("n") * F.col("s.a") / F.col("s.b")
    sizes = base.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).select("_g", "n", F.explode(cuts).alias("s"))
    rank = (F.ceil(exact) if rounding == "ceil" else F.floor(exact)).cast("long").alias("rank")
    places = cut_lineage(sizes.select("_g", F.col("s.i").alias("i"), F.lit("").alias("prefix"), rank, "n"))
    found = [places.where("rank < 1").select("_g", "i", F.lit("").alias("_h"))]
    open_, length = places.where("rank > 0"), 0
    while True:
        last = length + DIGITS > HASH_DIGITS
        ready = open_ if last else open_.where(F.col("n") <= small)
        found.append(_cuts_below(base, ready, length))
        open_ = open_.where(F.lit(False)) if last else open_.where(F.col("n") > small)
        if open_.isEmpty():
            break
        heads = _sized(open_.select("_g", "prefix").distinct())
        rows = base.withColumn("prefix", F.substring("_h", 1, length)).join(heads, ["_g", "prefix"])
        counts = rows.groupBy("_g", "prefix", F.substring("_h", 1, length + DIGITS).alias("next")).agg(F.count(F.lit(1)).alias("m"))
        before = Window.partitionBy("_g", "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
        inside = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("m"))
        narrowed = counts.join(_sized(open_), ["_g", "prefix"]).where(inside)
        open_ = cut_lineage(
            narrowed.select("_g", "i", F.col("next").alias("prefix"), (F.col("rank") - F.col("before")).alias("rank"), F.col("m").alias("n"))
        )
        length += DIGITS
    cut = found[0]
    for f in found[1:]:
        cut = cut.unionByName(f)
    table = cut.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "_h"))).alias("_c"))
    label = F.when(F.col("_g") != "", F.substring("_g", 2, 1 << 30))
    return cut_lineage(table.select(label.alias("_class"), F.transform("_c", lambda c: c["_h"]).alias("_cuts")))


def _sized(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Broadcast if it has at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def _cuts_below(base: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(_g, i, _h): the hash at each rank below a prefix."""
    rows = base.withColumn("prefix", F.substring("_h", 1, length)).join(_sized(places), ["_g", "prefix"])
    # equal keys share a hash, so copies are counted before the window
    counts = rows.groupBy("_g", "i", "rank", "_h").agg(F.count(F.lit(1)).alias("m"))
    so_far = Window.partitionBy("_g", "i").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("cum", F.sum("m").over(so_far)).where(F.col("cum") >= F.col("rank"))
    return reached.groupBy("_g", "i").agg(F.min("_h").alias("_h"))


def hash_cuts(
    df: DataFrame, key: str, seed: int, shares: Sequence[tuple[int, int]], rounding: str = "floor", small: int = BUCKET_ROWS
) -> dict[None, list[str]]:
    """The cuts of the whole table (`hash_cut_table`) under None, one for each share; an empty table has cuts of ''."""
    row = hash_cut_table(df, key, seed, shares, None, rounding, small).first()
    return {None: list(row["_cuts"]) if row else [""] * len(shares)}


# --------------------------------------------------------------------------
# position in a total order of any type
# --------------------------------------------------------------------------


def dense_codes(values: DataFrame, column: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add `code`, the 0-based position of each (distinct) value in sort order.

    Above `small_rows` the values are range-sorted into partitions and
    materialised; a row's code is then its place in the partition plus the
    rows of the partitions before it (one offset per partition).
    """
    from .session import cut_lineage

    if values.count() <= small_rows:
        return values.withColumn("code", F.row_number().over(Window.orderBy(q(column))) - 1)
    placed = cut_lineage(values.orderBy(q(column))).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns(
        {"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = placed.groupBy("_part").agg((F.max("_place") + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition of the sort
    return placed.join(F.broadcast(offsets), "_part").select(
        *[q(c) for c in values.columns], (F.col("_before") + F.col("_place")).cast("int").alias("code")
    )
