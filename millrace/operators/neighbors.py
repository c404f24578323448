"""Exact k nearest neighbours as a pruned block join.

Train rows are put into cells whose number follows the table: the leaves of a k-d
tree, by the coordinates that a row misses, or, with many coordinates, Voronoi cells
around a bounded set of pivots.  A query looks at its own leaf first; the distance of
its k-th row there bounds what it has to visit of the others.  A Voronoi cell is
described by its bounding box, the interval of its rows' distances to the pivot
and the k-th smallest of them.  A query visits only the cells that can hold one
of its k nearest rows: the triangle inequality on the intervals, the planes
halfway between pivots, and the boxes bound its distance to a cell from below,
and k rows lie within its distance to a pivot plus the k-th of that cell.
Where coordinates are missing the distance is no metric, and boxes alone decide.
Both inputs, with their cells and visits, are written once.  Cells and their visitors are cut into chunks
of bounded size, so a hot cell becomes many tasks; each task computes one
(visitors x rows) distance block with numpy and returns k rows per visitor.
The result is exact: no candidate is dropped that a bound does not exclude.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..dist import q
from ..session import cut_lineage, kernel_tasks

CELL_ROWS = 2048
MAX_CELLS = 1024
#: tables of up to so many coordinates are cut by a k-d tree, others into Voronoi cells
SPLIT_DIMS = 10
MAX_LEAVES = 1 << 17
RUN_CELLS = 128
CHUNK_ROWS = 2048
VISITS_PER_CHUNK = 16384
BLOCK_CELLS = 2_000_000


def feature_array(columns: Sequence[str]):
    """Array of doubles with NaN for missing."""
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(q(c).cast("double"), nan) for c in columns])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.empty((0, 0))


def block_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Distances between rows of a and b, NaN coordinates skipped and the sum
    scaled by all/present coordinates (NaN when none is shared)."""
    dims = a.shape[1]
    total = np.zeros((len(a), len(b)))
    gaps = bool(np.isnan(a).any() or np.isnan(b).any())
    shared = np.zeros_like(total) if gaps else None
    for j in range(dims):
        diff = np.subtract.outer(a[:, j], b[:, j])
        diff = diff * diff if p == 2 else np.abs(diff)
        if gaps:
            known = ~np.isnan(diff)
            shared += known
            diff = np.where(known, diff, 0.0)
        total += diff
    if gaps:
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(shared > 0, total * (dims / shared), np.nan)
    return np.sqrt(total) if p == 2 else total


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows without missing coordinates by a matrix product; pairs
    so near that it would lose digits are computed from their differences."""
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    i, j = np.nonzero(square <= 1e-6 * (aa[:, None] + bb[None, :]))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        square[i[part], j[part]] = ((a[i[part]] - b[j[part]]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite entries of each row, ties by column."""
    d = np.where(np.isnan(d), np.inf, d)
    if d.shape[1] > k:
        edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
    else:
        rows, cols = np.nonzero(np.isfinite(d))
    order = np.lexsort((cols, d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _box_bounds(x: np.ndarray, cells: dict, p: int):
    """Lower and upper distance (to the power p) of each query to each cell.

    Shared coordinates number between those always present in the cell and
    those ever present, which bounds the scaling factor from both sides.
    """
    lo, hi, always, ever = cells["lo"], cells["hi"], cells["always"], cells["ever"]
    dims = x.shape[1]
    low = np.zeros((len(x), len(lo)))
    up = np.zeros((len(x), len(lo)))
    sure = np.zeros((len(x), len(lo)))
    for j in range(dims):
        v = x[:, j][:, None]
        known = ~np.isnan(v)
        gap = np.maximum(np.maximum(lo[None, :, j] - v, v - hi[None, :, j]), 0.0)
        far = np.maximum(np.abs(v - lo[None, :, j]), np.abs(v - hi[None, :, j]))
        if p == 2:
            gap, far = gap * gap, far * far
        low += np.where(known & always[None, :, j], gap, 0.0)
        up += np.where(known & ever[None, :, j], far, 0.0)
        sure += known & always[None, :, j]
    up = np.where(sure > 0, up * (dims / np.maximum(sure, 1)), np.inf)
    return low, up


def _metric_bounds(x: np.ndarray, cells: dict, p: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows without missing coordinates: a lower bound of the distance to each cell, and a
    distance within which there are surely k rows."""
    d = block_distances(x, cells["pivot"], p)
    low = np.maximum(d - cells["far"][None, :], cells["near"][None, :] - d)
    if p == 2:
        # rows of a cell are not nearer to the query's pivot than to their own
        own = np.argmin(d, axis=1)
        apart = cells["apart"][own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d * d - np.take_along_axis(d, own[:, None], 1) ** 2) / (2 * apart)
        low = np.maximum(low, np.where(apart > 0, plane, 0.0))
    reach = np.sort(d + cells["kth"][None, :], axis=1)[:, 0]
    order = np.argsort(d + cells["far"][None, :], axis=1, kind="stable")
    enough = np.cumsum(cells["n"][order], axis=1) >= k
    whole = np.take_along_axis(d + cells["far"][None, :], order, 1)
    several = np.where(enough.any(axis=1), whole[np.arange(len(x)), np.argmax(enough, axis=1)], np.inf)
    return np.maximum(low, 0.0), np.minimum(reach, several)


def _visited(x: np.ndarray, cells: dict, p: int, k: int, radius: np.ndarray) -> np.ndarray:
    """Which cells (columns) each query (row) has to visit; k rows are known within `radius`."""
    low, up = _box_bounds(x, cells, p)
    order = np.argsort(up, axis=1, kind="stable")
    reach = np.cumsum(cells["n"][order], axis=1) >= k
    enough = np.argmax(reach, axis=1)
    limit = np.where(reach.any(axis=1), np.take_along_axis(up, order, 1)[np.arange(len(x)), enough], np.inf)
    keep = low <= np.minimum(limit * (1 + 1e-9), radius**p)[:, None]
    whole = ~np.isnan(x).any(axis=1)
    if "far" in cells and whole.any():
        near, within = _metric_bounds(x[whole], cells, p, k)
        scale = 1e-9 * (1 + np.abs(x[whole]).sum(axis=1) + np.abs(cells["pivot"]).sum(axis=1).max())
        keep[whole] &= near <= (np.minimum(within * (1 + 1e-9), radius[whole]) + scale)[:, None]
    return keep


def _leaf_of(splits: dict, x: np.ndarray) -> np.ndarray:
    """Leaf of each row in a k-d tree: x <= cut goes left, a leaf has feature -1.  Missing coordinates count as 0."""
    x, rows = np.nan_to_num(x, nan=0.0), np.arange(len(x))
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        f = splits["feature"][at]
        if (f < 0).all():
            return splits["leaf"][at]
        right = x[rows, np.maximum(f, 0)] > splits["cut"][at]
        at = np.where(f >= 0, splits["left"][at] + right, at)


def _split_space(x: np.ndarray, leaves: int) -> dict:
    """Halve the rows of x along their widest coordinate until there are `leaves` parts."""
    x = np.nan_to_num(x, nan=0.0)
    feature, cut, left = [-1], [0.0], [0]
    stack = [(0, np.arange(len(x)), leaves)]
    while stack:
        node, rows, parts = stack.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        if parts < 2 or not (high > low).any():
            continue
        f = int(np.argmax(high - low))
        v = np.sort(part[:, f])
        at = v[(len(v) - 1) // 2]
        if at == v[-1]:  # the upper half is one value
            at = v[np.searchsorted(v, at) - 1]
        below = part[:, f] <= at
        feature[node], cut[node], left[node] = f, at, len(feature)
        feature += [-1, -1]
        cut += [0.0, 0.0]
        left += [0, 0]
        stack += [(left[node], rows[below], parts // 2), (left[node] + 1, rows[~below], parts - parts // 2)]
    found = {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left)}
    return {**found, "leaf": np.cumsum(found["feature"] < 0) - 1}


def _pattern(x: np.ndarray) -> np.ndarray:
    """Which coordinates are missing, as bits."""
    return (np.isnan(x) @ (1 << np.arange(x.shape[1]))).astype("int32")


def _box_low(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, always: np.ndarray, ever: np.ndarray, p: int) -> np.ndarray:
    """Lower distance (to the power p) of each query to each box; at least as many coordinates are scaled
    away as the query and the box surely do not share."""
    total, most = np.zeros((len(x), len(lo))), np.zeros((len(x), len(lo)))
    for j in range(x.shape[1]):
        v = x[:, j][:, None]
        known = ~np.isnan(v)
        gap = np.maximum(np.maximum(lo[None, :, j] - v, v - hi[None, :, j]), 0.0)
        total += np.where(known & always[None, :, j], gap * gap if p == 2 else gap, 0.0)
        most += known & ever[None, :, j]
    return np.where(most > 0, total * (x.shape[1] / np.maximum(most, 1)), np.inf)


def _boxes_within(x: np.ndarray, limit: np.ndarray, cells: dict, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) whose distance (to the power p) may be within the query's limit: runs of cells first, then cells."""
    names, runs = ("lo", "hi", "always", "ever"), cells["runs"]
    rows, found = [], []
    for at in range(0, len(x), 1024):
        part, most = x[at : at + 1024], limit[at : at + 1024]
        near = _box_low(part, *(runs[c] for c in names), p) <= most[:, None]
        for r in np.flatnonzero(near.any(axis=0)):
            who = np.flatnonzero(near[:, r])
            own = slice(r * RUN_CELLS, (r + 1) * RUN_CELLS)
            i, c = np.nonzero(_box_low(part[who], *(cells[c][own] for c in names), p) <= most[who][:, None])
            rows.append(at + who[i])
            found.append(r * RUN_CELLS + c)
    if not rows:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def _prune(base, dims: int, n_train: int, k: int, p: int, cell_rows: int):
    """Train rows with their cell (written once), the number of train rows per cell, and two
    column functions: the cells of x to look at first, and the others within a distance of x."""
    space = dims <= SPLIT_DIMS
    n_cells = max(1, min(MAX_LEAVES if space else MAX_CELLS, math.ceil(n_train / cell_rows)))
    # A bounded pick in hash order; it shapes cells, not results.
    picked = base.orderBy(F.xxhash64("neighbor_id"), "neighbor_id").select("x").limit(n_cells * (4 if space else 1)).collect()
    sample = np.array([r["x"] for r in picked], dtype=float)
    pivots = splits = None
    if space:
        splits = _split_space(sample, n_cells)
    else:
        pivots = np.unique(np.nan_to_num(sample), axis=0)
    shape = base.sparkSession.sparkContext.broadcast((splits, pivots))

    def home(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        splits, pivots = shape.value
        if splits is not None:
            return _leaf_of(splits, m), np.zeros(len(m))
        cell, away = np.empty(len(m), dtype=int), np.empty(len(m))
        for at in range(0, len(m), 1024):
            part = m[at : at + 1024]
            d = np.nan_to_num(block_distances(part, pivots, 2), nan=np.inf)
            best = np.argmin(d, axis=1)
            cell[at : at + 1024] = best
            # one row and its pivot at a time
            away[at : at + 1024] = d[np.arange(len(part)), best] if p == 2 else np.abs(part - pivots[best]).sum(axis=1)
        return cell, away

    @F.pandas_udf("cell int, away double")
    def cell_of(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "away": pd.Series([], dtype="float64")})
        m = _matrix(x)
        cell, away = home(m)
        # rows that miss other coordinates are other cells of the leaf
        return pd.DataFrame({"cell": ((_pattern(m) if space else 0) * MAX_LEAVES + cell).astype("int32"), "away": away})

    placed = cut_lineage(base.withColumn("at", cell_of("x")).select(*base.columns, "at.cell", "at.away"))
    clean_x = [F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]) for j in range(dims)]
    boxes = (
        placed.groupBy("cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.min(c) for c in clean_x]).alias("lo"),
            F.array(*[F.max(c) for c in clean_x]).alias("hi"),
            F.array(*[F.count(c) for c in clean_x]).alias("present"),
            F.min("away").alias("near"),
            F.max("away").alias("far"),
        )
        .orderBy("cell")
        .collect()  # a row for each cell: one of cell_rows train rows or more, on average
    )
    size = np.array([b["n"] for b in boxes])
    present = np.array([b["present"] for b in boxes])
    cells = {
        "id": np.array([b["cell"] for b in boxes]),
        "lo": np.array([b["lo"] for b in boxes], dtype=float),
        "hi": np.array([b["hi"] for b in boxes], dtype=float),
        "always": present == size[:, None],
        "ever": present > 0,
        # only rows that surely share a coordinate count towards k
        "n": size,
    }
    if not space and cells["always"].all():
        nearest = Window.partitionBy("cell").orderBy("away")
        kth = placed.select("cell", "away").withColumn("r", F.row_number().over(nearest)).where(F.col("r") == k)
        kth = {r["cell"]: r["away"] for r in kth.collect()}  # at most one row for each cell
        cells["pivot"] = pivots[cells["id"]]
        cells["apart"] = block_distances(cells["pivot"], cells["pivot"], p)
        cells["near"], cells["far"] = (np.array([b[c] for b in boxes], dtype=float) for c in ("near", "far"))
        cells["kth"] = np.array([kth.get(b["cell"], np.inf) for b in boxes])
    cells["lo"] = np.nan_to_num(cells["lo"], nan=0.0)
    cells["hi"] = np.nan_to_num(cells["hi"], nan=0.0)
    ends = np.arange(0, len(size), RUN_CELLS)
    cells["runs"] = {
        "lo": np.minimum.reduceat(cells["lo"], ends), "hi": np.maximum.reduceat(cells["hi"], ends),
        "always": np.logical_and.reduceat(cells["always"], ends), "ever": np.logical_or.reduceat(cells["ever"], ends),
    }
    leaf = cells["id"] % MAX_LEAVES
    order = np.argsort(leaf, kind="stable")
    cells["of_leaf"] = (leaf[order], cells["id"][order])
    shared_cells = base.sparkSession.sparkContext.broadcast(cells)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def first_of(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        leaves, ids = shared_cells.value["of_leaf"]
        own = home(_matrix(x))[0]
        ends = zip(np.searchsorted(leaves, own, "left"), np.searchsorted(leaves, own, "right"))
        return pd.Series([ids[a:b].astype("int32") for a, b in ends])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def others_of(x: pd.Series, within: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        c, m = shared_cells.value, _matrix(x)
        own, radius = home(m)[0], within.to_numpy(dtype=float)
        radius = np.where(np.isnan(radius), np.inf, radius) * (1 + 1e-9)
        if space:
            rows, found = _boxes_within(m, radius**p, c, p)
        else:
            step = max(1, BLOCK_CELLS // len(c["id"]))
            keep = np.concatenate([_visited(m[i : i + step], c, p, k, radius[i : i + step]) for i in range(0, len(m), step)])
            rows, found = np.nonzero(keep)
        found = c["id"][found]
        other = found % MAX_LEAVES != own[rows]
        rows, found = rows[other], found[other].astype("int32")
        return pd.Series(np.split(found, np.searchsorted(rows, np.arange(1, len(m)))))

    return placed.drop("away"), {int(b["cell"]): b["n"] for b in boxes}, first_of, others_of


def _nearest_in_block(a: np.ndarray, b: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest rows of b for each row of a, ties by column.

    Without missing coordinates a matrix product finds the candidates, whose
    distances are then computed as everywhere else.
    """
    if p != 2 or a.shape[1] < 8 or len(b) <= k or np.isnan(a).any() or np.isnan(b).any():
        d = block_distances(a, b, p)
        at, best = smallest(d, k)
        return at, best, d[at, best]
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    rough = aa[:, None] + bb[None, :] - 2 * (a @ b.T)
    edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
    at, best = np.nonzero(rough <= (edge + 1e-9 * (aa + bb.max() + 1))[:, None])
    total = np.zeros(len(at))
    for j in range(a.shape[1]):
        diff = a[at, j] - b[best, j]
        total += diff * diff
    d = np.sqrt(total)
    order = np.lexsort((best, d, at))
    at, best, d = at[order], best[order], d[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at, side="left") < k
    return at[keep], best[keep], d[keep]


def nearest_rows(
    queries: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    query_id: str,
    train_id: str,
    k: int,
    payload: str | None = None,
    p: int = 2,
    cell_rows: int = CELL_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, neighbor_id, distance, payload, rank): the k nearest train
    rows of every query, ties by the smaller id; ids keep their type, payload is double.
    `report` gets the number of cells and the share of them that a query visits."""
    spark = queries.sparkSession
    load = F.lit(None).cast("double") if payload is None else q(payload).cast("double")
    base = train.select(
        q(train_id).alias("neighbor_id"), feature_array(features).alias("x"), load.alias("payload")
    )
    ask = queries.select(q(query_id).alias("query_id"), feature_array(features).alias("x"))
    base, ask = cut_lineage(base), cut_lineage(ask)
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((ask, "query_id"), (base, "neighbor_id"))}
    pair = f"query_id {kinds['query_id']}, neighbor_id {kinds['neighbor_id']}, distance double, payload double"
    empty = f"{pair}, rank int"
    n_train = base.count()
    if n_train == 0:
        return spark.createDataFrame([], empty)

    visits = 0

    def block(ask_rows: pd.DataFrame, train_rows: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "neighbor_id", "distance", "payload"]
        if not len(ask_rows) or not len(train_rows):
            return pd.DataFrame({c: [] for c in names})
        train_rows = train_rows.sort_values("neighbor_id")
        b = _matrix(train_rows["x"])
        ids, load_ = train_rows["neighbor_id"].to_numpy(), train_rows["payload"].to_numpy()
        out = []
        a_all, q_all = _matrix(ask_rows["x"]), ask_rows["query_id"].to_numpy()
        step = max(1, BLOCK_CELLS // len(b))
        for i in range(0, len(a_all), step):
            at, best, d = _nearest_in_block(a_all[i : i + step], b, k, p)  # rows of b are in id order
            out.append(
                pd.DataFrame(
                    {
                        "query_id": q_all[i : i + step][at],
                        "neighbor_id": ids[best],
                        "distance": d,
                        "payload": load_[best],
                    }
                )
            )
        return pd.concat(out)

    keys = ["cell", "part", "team"]
    tasks = kernel_tasks(spark)

    def search(visiting: DataFrame) -> DataFrame:
        """The k nearest of the rows of the cells visited, from each block."""
        nonlocal visits
        traffic = {r["cell"]: r["n"] for r in visiting.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        visits += sum(traffic.values())
        plan_rows = [(c, math.ceil(n / chunk_rows), math.ceil(traffic[c] / VISITS_PER_CHUNK)) for c, n in sizes.items() if traffic.get(c)]
        if not plan_rows:
            return spark.createDataFrame([], pair)
        plan = spark.createDataFrame(plan_rows, "cell int, parts int, teams int")
        # Rows go to one part of their cell and every team; visitors to one team and every part.
        rows = (
            placed.join(F.broadcast(plan), "cell")
            .withColumn("part", F.pmod(F.xxhash64("neighbor_id"), "parts").cast("int"))
            .withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1)))
            .select("cell", "part", "team", "neighbor_id", "x", "payload")
        )
        visitors = (
            visiting.join(F.broadcast(plan), "cell")
            .withColumn("team", F.pmod(F.xxhash64("query_id"), "teams").cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("cell", "part", "team", "query_id", "x")
        )
        return (
            visitors.repartition(tasks, *keys)
            .groupBy(*keys)
            .cogroup(rows.repartition(tasks, *keys).groupBy(*keys))
            .applyInPandas(block, pair)
        )

    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # A train side of one cell is visited by everyone; otherwise each query looks at its own
    # leaf first and then at the cells that are within the distance of its k-th row.
    if n_train <= cell_rows:
        placed, sizes = base.withColumn("cell", F.lit(0)), {0: n_train}
        out = ranked(search(ask.withColumn("cell", F.lit(0))))
    else:
        placed, sizes, first_of, others_of = _prune(base, len(features), n_train, k, p, cell_rows)
        first = cut_lineage(ranked(search(ask.select("query_id", "x", F.explode(first_of("x")).alias("cell")))).drop("rank"))
        within = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("within"))
        visiting = cut_lineage(ask.join(within, "query_id", "left").withColumn("cells", others_of("x", "within")))
        out = ranked(first.unionByName(search(visiting.select("query_id", "x", F.explode("cells").alias("cell")))))
    if report is not None:
        report["cells"] = len(sizes)
        report["visited"] = visits / max(1, ask.count() * len(sizes))
    return out


def knn_predict(
    queries: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    label: str,
    query_id: str,
    train_id: str,
    k: int = 5,
    task: str = "classification",
    weights: str = "uniform",
    p: int = 2,
) -> DataFrame:
    """(query_id, prediction) by vote (ties: smallest class) or average; votes
    also give `shares`, the share of the (weighted) votes of each class voted for."""
    near = nearest_rows(queries, train, features, query_id, train_id, k, payload=label, p=p)
    if weights == "distance":
        # an exact hit outweighs everything else
        hit = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("query_id"))
        near = near.withColumn("_hit", hit).withColumn(
            "w",
            F.when(F.col("_hit") == 1, (F.col("distance") == 0).cast("double")).otherwise(
                1.0 / F.when(F.col("distance") != 0, F.col("distance"))
            ),
        )
    else:
        near = near.withColumn("w", F.lit(1.0))
    if task == "regression":
        mean = F.sum(F.col("w") * F.col("payload")) / F.sum("w")
        return near.groupBy("query_id").agg(mean.alias("prediction"))
    votes = near.groupBy("query_id", "payload").agg(F.sum("w").alias("v"))
    total = votes.groupBy("query_id").agg(  # at most k entries
        F.max_by("payload", F.struct("v", -F.col("payload"))).alias("prediction"),
        F.sum("v").alias("all"),
        F.collect_list(F.struct(F.col("payload").cast("int").alias("c"), "v")).alias("votes"),
    )
    shares = F.map_from_entries(F.transform("votes", lambda x: F.struct(x["c"], x["v"] / F.col("all"))))
    return total.select("query_id", "prediction", shares.alias("shares"))
