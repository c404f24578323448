"""Questions about a table of tuning trials.

trials: trial, value, state (COMPLETE / PRUNED / FAIL), optionally started,
duration_s and params (map of strings).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import q, running_max
from ..session import cut_lineage

BLOCK_POINTS = 4_096
#: cells of the grid; their pairs are one table
MOST_CELLS = 1_000


def _complete() -> Column:
    return F.col("state") == "COMPLETE"


def _better(direction: str, column: str = "value") -> Column:
    return q(column).desc_nulls_last() if direction == "maximize" else q(column).asc_nulls_last()


def best_trial(trials: DataFrame, direction: str = "maximize") -> DataFrame:
    """The complete trial with the best value; the earliest on ties."""
    return trials.where(_complete()).orderBy(_better(direction), "trial").limit(1)


def history(trials: DataFrame, params: Sequence[str]) -> DataFrame:
    """Trials with one `param_*` column per parameter."""
    kept = [c for c in trials.columns if c != "params"]
    return trials.select(*kept, *[F.col("params")[p].alias(f"param_{p}") for p in params])


def best_so_far(trials: DataFrame, direction: str = "maximize") -> DataFrame:
    """(trial, value, best): running best over complete trials in trial order."""
    sign = 1.0 if direction == "maximize" else -1.0
    rows = trials.where(_complete()).select("trial", "value", (F.col("value") * F.lit(sign)).alias("_v"))
    ahead = running_max(rows, "trial", "_v", "_ahead")
    return ahead.select("trial", "value", (F.greatest("_ahead", "_v") * F.lit(sign)).alias("best"))


def param_ranges(trials: DataFrame) -> DataFrame:
    """(param, low, high, range, n) of numeric parameter values."""
    long = trials.select(F.explode("params").alias("param", "text")).withColumn("v", F.col("text").try_cast("double"))
    return long.where("v IS NOT NULL").groupBy("param").agg(
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        (F.max("v") - F.min("v")).alias("range"),
        F.count(F.lit(1)).alias("n"),
    )


def parallel_coordinates(trials: DataFrame) -> DataFrame:
    """(trial, value, param, text) of complete trials."""
    return trials.where(_complete()).select("trial", "value", F.explode("params").alias("param", "text"))


def prune_below_median(scores: DataFrame, direction: str = "maximize") -> DataFrame:
    """Scores (round, trial, value) with `keep`: not worse than the round's median."""
    median = scores.groupBy("round").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    kept = F.col("value") >= F.col("median") if direction == "maximize" else F.col("value") <= F.col("median")
    # one row per round
    return scores.join(F.broadcast(median), "round").select("round", "trial", "value", "median", kept.alias("keep"))


def study_summary(trials: DataFrame, direction: str = "maximize") -> DataFrame:
    """Counts by state, best trial, and improvement over the first complete trial in %."""
    done = _complete() & F.col("value").isNotNull()
    value = F.when(done, F.col("value"))
    rank = F.struct(value if direction == "maximize" else -value, -F.col("trial"))
    best = F.max_by(F.struct("trial", "value"), F.when(done, rank))
    first = F.min_by("value", F.when(done, F.col("trial")))
    rows = trials.agg(
        F.count(F.lit(1)).alias("trials"),
        F.count(F.when(F.col("state") == "COMPLETE", 1)).alias("complete"),
        F.count(F.when(F.col("state") == "PRUNED", 1)).alias("pruned"),
        F.count(F.when(F.col("state") == "FAIL", 1)).alias("failed"),
        best.alias("b"),
        first.alias("first_value"),
    )
    gain = F.try_divide(F.col("b.value") - F.col("first_value"), F.abs("first_value")) * 100.0
    return rows.select(
        "trials", "complete", "pruned", "failed",
        F.col("b.trial").alias("best_trial"),
        F.col("b.value").alias("best_value"),
        (gain if direction == "maximize" else -gain).alias("improvement_pct"),
    )


def pareto_front(trials: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """Trials that no other trial matches in all objectives and beats in one.

    Two objectives need no pairs at all: in order of the first, a trial stays
    when it beats the running best of the second.  With more objectives, points
    are put into the cells of a grid (`_grid_front`).
    """
    rows = trials.where(_complete())
    for c in objectives:
        rows = rows.where(q(c).isNotNull())
    signed = {f"_o{i}": (q(c) if d == "maximize" else -q(c)) for i, (c, d) in enumerate(objectives.items())}
    rows = rows.withColumns(signed)
    names = list(signed)
    if len(names) == 1:
        top = rows.agg(F.max(names[0]).alias("m"))
        return rows.join(F.broadcast(top), rows[names[0]] == top["m"]).drop("m", *names)
    points = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    if len(names) == 2:
        a, b = names
        steps = points.groupBy(a).agg(F.max(b).alias(b)).withColumn("_down", -F.col(a))
        ahead = running_max(steps, "_down", b, "_seen")
        front = ahead.where(F.col("_seen").isNull() | (F.col(b) > F.col("_seen"))).select(a, b)
    else:
        front = _grid_front(points, names)
    return rows.join(front, names, "left_semi").drop(*names)


def _beaten(a, b):
    """Which rows of a some row of b matches in all objectives and beats in one."""
    import numpy as np

    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 256):
        part = a[i : i + 256, None, :]
        out[i : i + 256] = ((b[None] >= part).all(axis=2) & (b[None] > part).any(axis=2)).any(axis=1)
    return out


def _cells(points: DataFrame, names: Sequence[str], slices: int) -> DataFrame:
    """points with `cell`, the number of the grid cell: quantiles of each objective are its slices."""
    shares = [i / slices for i in range(1, slices)]
    cuts = points.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).first()
    cell = F.lit(0)
    for n in names:
        place = F.lit(0)
        for c in sorted(set(cuts[n] or [])):
            place = place + F.when(F.col(n) >= c, 1).otherwise(0)
        cell = cell * slices + place
    return points.withColumn("cell", cell.cast("int"))


def _grid_front(
    points: DataFrame, names: Sequence[str], block_points: int | None = None, report: dict | None = None
) -> DataFrame:
    """The front of distinct points, larger being better, by a grid of at most MOST_CELLS cells.

    A cell that another cell with points beats in every slice is dropped as a
    whole.  Fronts of the other cells, in blocks of bounded size, are compared
    only with cells that are at least as good in every slice: a point is copied
    once for each block of those, whatever the number of points elsewhere.
    `report` gets the rows that survive their blocks and the copies made of them.
    """
    import numpy as np
    import pandas as pd

    names, block_points = list(names), block_points or BLOCK_POINTS
    schema = ", ".join(f"{n} double" for n in names) + ", cell int, part int"
    # about half a block of points for each cell
    wanted = min(MOST_CELLS, 2 * points.count() / block_points)
    slices = max(2, int(max(wanted, 1.0) ** (1 / len(names)) + 1e-9))
    placed = cut_lineage(_cells(points.select(*[F.col(n).cast("double").alias(n) for n in names]), names, slices))

    def sizes(table: DataFrame) -> dict[int, int]:
        return {r["cell"]: r["n"] for r in table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row per cell

    def parted(table: DataFrame, counts: dict[int, int]) -> DataFrame:
        parts = [(c, math.ceil(n / block_points)) for c, n in counts.items()]
        parts = table.sparkSession.createDataFrame(parts or [(-1, 1)], "cell int, parts int")
        rows = table.join(F.broadcast(parts), "cell")  # a row per cell
        return rows.withColumn("part", F.pmod(F.xxhash64(*names), "parts").cast("int")).drop("parts")

    full = sizes(placed)
    cells = np.array(sorted(full), dtype=np.int64)
    at = np.stack([cells // slices ** (len(names) - 1 - j) % slices for j in range(len(names))], axis=1)
    # the dominance bitmap of cells: beaten in every slice, or perhaps beaten
    above, beaten = np.ones((len(cells), len(cells)), bool), np.ones((len(cells), len(cells)), bool)
    for j in range(len(names)):
        above &= at[None, :, j] >= at[:, None, j]
        beaten &= at[None, :, j] > at[:, None, j]
    left = {int(c): full[int(c)] for c in cells[~beaten.any(axis=1)]}

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[names].to_numpy(dtype=float)
        return pdf.loc[~_beaten(m, m), [*names, "cell", "part"]]

    fronts = cut_lineage(parted(placed, left).groupBy("cell", "part").applyInPandas(front, schema)).drop("part")
    kept = sizes(fronts)
    blocks = {c: math.ceil(n / block_points) for c, n in kept.items()}
    pairs = [
        (int(b), int(a), blocks[int(b)], blocks[int(a)])
        for b, better in zip(cells, above)
        if int(b) in blocks
        for a in cells[better]
        # a cell meets itself if its fronts came from several blocks
        if int(a) in blocks and (a != b or left[int(a)] > block_points)
    ]
    if report is not None:
        report["survivors"], report["copies"] = sum(kept.values()), sum(kept[b] * n for b, _, _, n in pairs)
    rows = parted(fronts, kept)
    if not pairs:
        return rows.select(*names)
    table = F.broadcast(points.sparkSession.createDataFrame(pairs, "worse int, better int, worse_parts int, better_parts int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keys = ["worse", "worse_part", "better", "better_part"]
    # both sides are the same rows: columns of the second get names of their own
    here = rows.withColumnsRenamed({"cell": "worse", "part": "worse_part"}).join(table, "worse")
    here = here.withColumnRenamed("better_parts", "parts").withColumn("better_part", every).select(*keys, *names)
    again = rows.select(F.col("cell").alias("better"), F.col("part").alias("better_part"), *[F.col(n).alias(n) for n in names])
    there = again.join(table.select(*[F.col(c).alias(c) for c in table.columns]), "better")
    there = there.withColumnRenamed("worse_parts", "parts").withColumn("worse_part", every).select(*keys, *[F.col(n).alias(n) for n in names])

    def losers(worse: pd.DataFrame, better: pd.DataFrame) -> pd.DataFrame:
        if not len(worse) or not len(better):
            return pd.DataFrame({n: [] for n in names})
        return worse.loc[_beaten(worse[names].to_numpy(dtype=float), better[names].to_numpy(dtype=float)), names]

    found = here.groupBy(*keys).cogroup(there.groupBy(*keys))
    gone = found.applyInPandas(losers, ", ".join(f"{n} double" for n in names)).distinct()
    return rows.select(*names).join(gone, names, "left_anti")
