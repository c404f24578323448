"""Correlations: Pearson, Spearman and Kendall, exact at any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import BUCKET_ROWS, SMALL_ROWS, numeric_columns, q, running_totals
from ..session import cut_lineage

PAIRS_PER_PASS = 400
#: cells of a task that ranks are joined to or gathered in
TASK_CELLS = 1_000_000


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(left_column, right_column, r) for i < j, pairwise complete.

    Up to PAIRS_PER_PASS pairs share one scan and one aggregate row.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "left_column string, right_column string, r double")
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        wide = df.agg(
            *[
                F.corr(q(a).cast("double"), q(b).cast("double")).alias(f"r{i}")
                for i, (a, b) in enumerate(chunk)
            ]
        )
        rows = [
            F.struct(
                F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.col(f"r{i}").alias("r")
            )
            for i, (a, b) in enumerate(chunk)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def correlated_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    return pearson_pairs(df, columns).where(F.abs("r") > threshold)


PAIRS = "left_column string, right_column string, r double"


def _by_name(df: DataFrame, pairs: list[tuple[str, str]], r: DataFrame) -> DataFrame:
    """r (pair, r) with the names of each pair; a pair without rows has a null r."""
    names = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, left_column string, right_column string"
    )
    return names.join(r, "pair", "left").select("left_column", "right_column", "r")


def _rank_sets(wide: DataFrame, width: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """Ranks that the pairs of columns c0, c1, ... need: (column, other), and the set of each (column, other).

    A column is ranked among the rows where another one is present too, so one
    ranking serves all others whose missing rows are the same.  Patterns are
    told apart by a hash of the row numbers they hold, in one pass.
    """
    marks = []
    for i in range(width):
        lost = F.col(f"c{i}").isNull()
        marks += [F.count(F.when(lost, 1)), F.bit_xor(F.when(lost, F.xxhash64("row"))), F.sum(F.when(lost, F.hash("row").cast("long")))]
    row = wide.agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)]).first()
    pattern = [tuple(row[3 * i : 3 * i + 3]) for i in range(width)]
    sets: list[tuple[int, int]] = []
    known: dict[tuple, int] = {}
    place = {}
    for a in range(width):
        for b in range(width):
            if a != b:
                # another column without missing rows, or with the same ones, changes nothing
                alone = not pattern[b][0] or pattern[b] == pattern[a]
                key = (a, None if alone else pattern[b])
                if key not in known:
                    known[key] = len(sets)
                    sets.append((a, a if alone else b))
                place[a, b] = known[key]
    return sets, place


def _frequent(ranks: DataFrame, least: float, sets: list[tuple[int, int]], width: int):
    """Kernel from rows (row, c0, c1, ...) to the same rows with `v`, the rank of each set: 0 where the row is
    not in the set, NaN where its value has fewer than `least` rows.  All other values are a table of a bounded size."""
    rows = ranks.where(F.col("n") >= least).select("set", "value", "rank").toPandas()
    known = []
    for s in range(len(sets)):
        mine = rows[rows["set"] == s].sort_values("value")
        known.append((mine["value"].to_numpy(), mine["rank"].to_numpy()))

    def look_up(batches):
        for batch in batches:
            x = [batch.column(f"c{i}") for i in range(width)]
            there = [c.is_valid().to_numpy(zero_copy_only=False) for c in x]
            x = [c.fill_null(0.0).to_numpy() for c in x]
            v = np.zeros((batch.num_rows, len(sets)))
            for s, ((a, b), (values, rank)) in enumerate(zip(sets, known)):
                found = np.full(batch.num_rows, np.nan)
                if len(values):
                    at = np.minimum(np.searchsorted(values, x[a]), len(values) - 1)
                    found = np.where(values[at] == x[a], rank[at], np.nan)
                v[:, s] = np.where(there[a] & there[b], found, 0.0)
            ends = pa.array(np.arange(0, v.size + 1, len(sets), dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "v"])

    return look_up


def spearman_matrix(df: DataFrame, columns: Sequence[str], bucket_rows: int = BUCKET_ROWS, frequent: int = SMALL_ROWS, task_cells: int = TASK_CELLS) -> DataFrame:
    """(left_column, right_column, r) for i < j, pairwise complete: Pearson on average ranks.

    All columns are ranked together, as rows (set, value), in one pass of
    prefix sums.  The ranks of frequent values, at most `frequent` of them, are
    looked up; those of the others return by one join, whose tasks get about
    `task_cells` cells each and no value of many rows.  One Gram matrix of the
    rank vectors has all pairs.  The number of jobs does not depend on the
    number of columns; more sets than columns are ranked only where patterns of
    missing values differ.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIRS)
    values = [q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    wide = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), *values))
    sets, place = _rank_sets(wide, len(columns))
    cells = [
        F.when(F.col(f"c{a}").isNotNull() & F.col(f"c{b}").isNotNull(), F.struct(F.lit(s).alias("set"), F.col(f"c{a}").alias("value")))
        for s, (a, b) in enumerate(sets)
    ]
    long = wide.select("row", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    counts = long.groupBy("set", "value").agg(F.count(F.lit(1)).alias("n"))
    before = cut_lineage(running_totals(counts, "value", {"before": "n"}, ["set"], bucket_rows))
    # ranks are counted from the middle of each set
    sizes = before.groupBy("set").agg(((F.sum("n") + 1) / 2).alias("mid"))
    ranks = before.join(F.broadcast(sizes), "set")  # one row for each set
    ranks = ranks.select("set", "value", "n", (F.col("before") + (F.col("n") + 1) / 2 - F.col("mid")).alias("rank"))
    least = (before.agg(F.sum("n")).first()[0] or 0) / frequent
    few = F.col("n") < least
    rare = before.where(few).groupBy("set").agg(F.sum("n").alias("n")).collect()  # one row for each set
    found = wide.mapInArrow(_frequent(ranks, least, sets, len(columns)), f"{', '.join(f'{c} {t}' for c, t in wide.dtypes)}, v array<double>")
    vectors = found.select("v")
    if rare:
        lost = [F.isnan(F.col("v")[r["set"]]) for r in rare]
        some = reduce(lambda a, b: a | b, lost)
        open_ = [F.when(i, F.struct(F.lit(r["set"]).alias("set"), F.col(f"c{sets[r['set']][0]}").alias("value"))) for i, r in zip(lost, rare)]
        tasks = -(-sum(r["n"] for r in rare) // task_cells)
        looked = found.where(some).select("row", "v", F.posexplode(F.filter(F.array(*open_), lambda c: c.isNotNull())))
        # the vector of a row travels with its first cell
        looked = looked.select("row", "col.set", "col.value", F.when(F.col("pos") == 0, F.col("v")).alias("v"))
        keys = ["set", "value"]
        looked = looked.repartition(tasks, *keys).join(ranks.where(few).drop("n").repartition(tasks, *keys), keys)
        if len(rare) > 1:
            cell = [F.max(F.when(F.col("set") == i, F.col("rank"))) for i in range(len(sets))]
            looked = looked.repartition(tasks, "row").groupBy("row").agg(F.array(*cell).alias("rank"), F.first("v", ignorenulls=True).alias("v"))
            full = F.zip_with("v", "rank", lambda v, rank: F.coalesce(rank, v))
        else:
            full = F.transform("v", lambda v, i: F.when(i == F.col("set"), F.col("rank")).otherwise(v))
        vectors = vectors.where(~some).unionByName(looked.select(full.alias("v")))
    left = [place[columns.index(a), columns.index(b)] for a, b in pairs]
    right = [place[columns.index(b), columns.index(a)] for a, b in pairs]

    def gram(batches):
        total = np.zeros((len(sets), len(sets)))
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, len(sets))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pairs), dtype=np.int32)), *(pa.array(total[i, j]) for i, j in ((left, right), (left, left), (right, right)))],
            names=["pair", "xy", "xx", "yy"],
        )

    sums = vectors.mapInArrow(gram, "pair int, xy double, xx double, yy double")
    r = F.try_divide(F.sum("xy"), F.sqrt(F.sum("xx") * F.sum("yy")))
    return _by_name(df, pairs, sums.groupBy("pair").agg(r.alias("r")))


def spearman(df: DataFrame, a: str, b: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (left_column, right_column, r)."""
    return spearman_matrix(df, [a, b], bucket_rows)


def _ranked(pairs: DataFrame, column: str, bucket_rows: int) -> DataFrame:
    """Dense index and number of rows of each distinct value of one side of each pair."""
    values = pairs.groupBy("pair", column).agg(F.sum("n").alias("n")).withColumn("one", F.lit(1).cast("long"))
    return running_totals(values, column, {"dense": "one"}, ["pair"], bucket_rows).select(
        "pair", column, F.col("dense").alias(f"dense_{column}"), F.col("n").alias(f"ties_{column}")
    )


def kendall_matrix(df: DataFrame, columns: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(left_column, right_column, r) for i < j, pairwise complete: Kendall's tau-b in O(n log n).

    Discordant pairs of rows are inversions.  Two x-positions first differ at exactly
    one bit of their dense index, so every pair is counted once if, for each
    bit, rows are grouped by the higher bits and the 0-side rows with a larger
    y are summed for each 1-side row.  That sum is a prefix sum over y, spread
    over range buckets; no pair of rows is ever formed.  All pairs of columns
    go through the same jobs.
    """
    columns = list(columns)
    names = list(combinations(columns, 2))
    if not names:
        return df.sparkSession.createDataFrame([], PAIRS)
    cells = [
        F.when(
            q(a).isNotNull() & q(b).isNotNull(),
            F.struct(F.lit(i).alias("pair"), q(a).cast("double").alias("x"), q(b).cast("double").alias("y")),
        )
        for i, (a, b) in enumerate(names)
    ]
    long = df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    pairs = cut_lineage(long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    rx, ry = _ranked(pairs, "x", bucket_rows), _ranked(pairs, "y", bucket_rows)
    rows = pairs.join(rx.select("pair", "x", "dense_x"), ["pair", "x"]).join(ry.select("pair", "y", "dense_y"), ["pair", "y"])

    def ties(counts):
        n = F.col(counts).cast("decimal(38,0)")
        return F.coalesce(F.sum(n * (n - 1)), F.lit(0)).cast("double") / 2

    # all sums of a pair come together in one shuffle
    size, none = F.sum("n").cast("double"), F.lit(0.0)
    sums = {name: [none] * i + [value] + [none] * (4 - i) for i, (name, value) in enumerate(
        (("n0", size * (size - 1) / 2), ("n1", ties("ties_x")), ("n2", ties("ties_y")), ("n3", ties("n"))))}
    facts = ["n0", "n1", "n2", "n3", "d"]

    def summed(table, name):
        return table.groupBy("pair").agg(*[c.alias(f) for c, f in zip(sums[name], facts)])

    parts = [summed(pairs, "n0"), summed(rx, "n1"), summed(ry, "n2"), summed(pairs, "n3")]
    top = rx.agg(F.max("dense_x")).first()[0] or 0
    bits = max(int(top).bit_length(), 1)
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    sided = rows.select("pair", "dense_x", "dense_y", "n", level.alias("level"))
    bit = F.expr("shiftright(dense_x, level) & 1")
    steps = sided.groupBy(
        "pair",
        "level",
        F.expr("shiftright(dense_x, level + 1)").alias("high"),
        # y in descending order: larger values come first
        (-F.col("dense_y")).alias("y"),
    ).agg(
        F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    run = running_totals(steps, "y", {"larger": "zeros"}, ["pair", "level", "high"], bucket_rows)
    discordant = F.sum(F.col("ones").cast("double") * F.col("larger"))
    parts.append(run.groupBy("pair").agg(*[none.alias(f) for f in facts[:4]], discordant.alias("d")))
    counted = reduce(DataFrame.unionByName, parts).groupBy("pair").agg(*[F.sum(f).alias(f) for f in facts])
    scale = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    tau = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - 2.0 * F.col("d")
    return _by_name(df, names, counted.select("pair", F.try_divide(tau, scale).alias("r")))


def kendall(df: DataFrame, a: str, b: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row (left_column, right_column, r)."""
    return kendall_matrix(df, [a, b], bucket_rows)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Upper triangle as rows (left_column, right_column, r)."""
    columns = list(columns if columns is not None else numeric_columns(df))
    return {"pearson": pearson_pairs, "spearman": spearman_matrix, "kendall": kendall_matrix}[method](df, columns)
