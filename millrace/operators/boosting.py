"""Gradient boosting of regression trees on counted cells.

The method and its defaults are MLlib's: thresholds at quantiles, trees by
variance, the first tree on the label (classes as -1 and 1) with weight 1, the
others on the negative gradient with the learning rate as weight.  A tree sees
a row only by the bins of its features, so rows with the same bins are one
cell: their number and label sums are all that a split needs.  Several classes
are one-vs-rest, and their trees grow side by side: a pass over the cells
returns the sums of one level for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import q
from ..session import cached, kernel_tasks

BLOCK_CELLS = 32_768
CELLS_PER_TASK = 16_384
#: rounds after which the margins of the cells are written anew
REFRESH = 10
#: a level's sums are collected from every task; deeper trees than this are MLlib's
DEEPEST = 8
BLOCKS = "bins binary, n binary, y binary, margin binary"

#: parameters that need single rows or random features: those fits are MLlib's
ROWWISE = {"subsample": 1.0, "max_features": None}


def handles(params: dict) -> bool:
    plain = all(params.get(name, given) in (given, "all", "auto") for name, given in ROWWISE.items())
    return plain and int(params.get("max_depth") or 3) <= DEEPEST


@dataclass
class Tree:
    """Nodes of a complete binary tree: the children of i are 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return self.value[self.leaves(bins, depth)]


def _number(column: str) -> Column:
    return F.coalesce(q(column).cast("double"), F.lit(float("nan")))


def thresholds(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Values at which each feature may be split (x <= t goes left): between all values, if there are at most
    `bins` of them, else at quantiles; at most bins - 1 of them, and one more that parts missing values from the others."""
    known = [F.when(~F.isnan(_number(c)), _number(c)) for c in features]
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(known)],
        *[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(known)],
        *[F.max(c).alias(f"m{i}") for i, c in enumerate(known)],
        *[F.count(F.when(c.isNull(), 1)).alias(f"g{i}") for i, c in enumerate(known)],
    ).first()
    few = [i for i in range(len(features)) if row[f"d{i}"] <= 1.2 * bins]
    values = df.agg(*[F.collect_set(known[i]).alias(f"v{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(features)):
        every = np.unique(values[f"v{i}"]) if i in few else np.array([])
        if i in few and len(every) <= bins:
            with np.errstate(invalid="ignore"):
                middle = (every[1:] + every[:-1]) / 2
            cuts = np.where(np.isfinite(middle), middle, every[:-1])
        else:
            cuts = np.unique(np.array(row[f"q{i}"] or [], dtype=float))
            cuts = cuts[cuts < row[f"m{i}"]]
        if row[f"g{i}"] and row[f"m{i}"] is not None and np.isfinite(row[f"m{i}"]):
            cuts = np.append(cuts, row[f"m{i}"])
        out.append(cuts)
    return out


def binned(df: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, y): the bins of each row's features, and its label."""
    split = [i for i, c in enumerate(cuts) if len(c)]
    work = df.select(*[_number(c).alias(f"x{i}") for i, c in enumerate(features)], q(label).cast("double").alias("y"))
    if split:
        # buckets are closed on the left: x > t is x >= the next double
        edges = [[-np.inf, *np.nextafter(cuts[i], np.inf).tolist(), np.inf] for i in split]
        work = Bucketizer(splitsArray=edges, inputCols=[f"x{i}" for i in split], outputCols=[f"b{i}" for i in split], handleInvalid="keep").transform(work)
    bins = [F.least(F.col(f"b{i}"), F.lit(float(len(c)))).cast("short") if len(c) else F.lit(0).cast("short") for i, c in enumerate(cuts)]
    return work.select(F.array(*bins).alias("bins"), "y")


def _cells(df: DataFrame, features: Sequence[str], label: str, classes: int, cuts: list[np.ndarray]) -> DataFrame:
    """(bins, n, y): the number of rows of each cell and, for each booster, its sum of labels or of rows of its class."""
    work = binned(df, features, label, cuts)
    if classes:
        sums = [F.count(F.when(F.col("y") == k, 1)).cast("double") for k in boosters(classes)]
    else:
        sums = [F.sum("y")]
    return work.groupBy("bins").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*sums).alias("y"))


def boosters(classes: int) -> list[int]:
    """Classes that have a booster; regression has one."""
    return list(range(classes)) if classes > 2 else [1]


def _blocks(cells: DataFrame, width: int, count: int) -> DataFrame:
    """Cells as matrices of bounded size, with margins of 0."""

    def pack(batches):
        held, size = [], 0

        def block():
            bins, n, y = (np.concatenate(part) for part in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([m.tobytes()]) for m in (bins, n, y, np.zeros_like(y))], names=["bins", "n", "y", "margin"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((
                b.column("bins").flatten().to_numpy().reshape(-1, width), b.column("n").to_numpy(),
                b.column("y").flatten().to_numpy().reshape(-1, count)))
            size += b.num_rows
            if size >= BLOCK_CELLS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return cells.mapInArrow(pack, BLOCKS)


def _opened(batch: pa.RecordBatch, width: int, count: int):
    for row in batch.to_pylist():
        yield (
            np.frombuffer(row["bins"], dtype=np.int16).reshape(-1, width), np.frombuffer(row["n"]),
            np.frombuffer(row["y"]).reshape(-1, count), np.frombuffer(row["margin"]).reshape(-1, count))


def _added(margin: np.ndarray, bins: np.ndarray, rounds: list, depth: int) -> np.ndarray:
    out = margin.copy()
    for rate, trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += rate * tree.predict(bins, depth)
    return out


def _targets(n: np.ndarray, y: np.ndarray, margin: np.ndarray | None, classes: int) -> np.ndarray:
    """Sum over each cell of what the next tree fits."""
    if not classes:
        return y if margin is None else 2 * (y - n[:, None] * margin)
    if margin is None:
        return 2 * y - n[:, None]
    # 4 / (1 + exp(2F)) for rows of the class, -4 / (1 + exp(-2F)) for the others
    share = 0.5 * (1 - np.tanh(margin))
    return 4 * (y * share - (n[:, None] - y) * (1 - share))


def _level(blocks: DataFrame, level: int, width: int, bins: int, classes: int, count: int, rounds: list, growing: list[Tree], first: bool, depth: int):
    """(n, sum) of the targets for each booster, node of the level, feature and bin."""
    nodes = 1 << level
    shape = (2, count, nodes, width, bins)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for codes, n, y, margin in _opened(batch, width, count):
                now = None if first else _added(margin, codes, rounds, depth)
                target = _targets(n, y, now, classes)
                for k, tree in enumerate(growing):
                    node = tree.leaves(codes, level) - (nodes - 1)
                    live = np.flatnonzero(node >= 0)
                    at, some, t = node[live] * bins, n[live], target[live, k]
                    for j in range(width):
                        place = at + codes[live, j]
                        total[0, k, :, j] += np.bincount(place, some, nodes * bins).reshape(nodes, bins)
                        total[1, k, :, j] += np.bincount(place, t, nodes * bins).reshape(nodes, bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    total = np.zeros(shape)
    for r in blocks.mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r["sums"]).reshape(shape)
    return total


def _split(tree: Tree, node: int, n: np.ndarray, s: np.ndarray, last: np.ndarray, least: int, least_gain: float) -> None:
    """Give a node (n and s: features x bins) its best split, or leave it a leaf."""
    rows, whole = n[0].sum(), s[0].sum()
    if not rows:
        return
    tree.value[node] = whole / rows
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
    right_n, right_s = rows - left_n, whole - left_s
    able = (left_n >= least) & (right_n >= least) & (left_n > 0) & (right_n > 0) & last
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_s**2 / left_n + right_s**2 / right_n - whole**2 / rows) / rows
    gain = np.where(able & (gain >= least_gain), gain, -np.inf)
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    # differences of rounding are no gain
    if not gain[j, b] > 1e-14 * max((whole / rows) ** 2, 1e-300):
        return
    tree.feature[node], tree.cut[node], tree.gain[node] = j, b, gain[j, b] * rows
    tree.value[2 * node + 1] = left_s[j, b] / left_n[j, b]
    tree.value[2 * node + 2] = right_s[j, b] / right_n[j, b]


def _new_tree(depth: int) -> Tree:
    size = (1 << (depth + 1)) - 1
    return Tree(np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size), np.zeros(size))


@dataclass
class Boosting:
    """Fitted boosters: rounds of (weight, a tree for each booster)."""

    name: str
    task: str
    features: list[str]
    cuts: list[np.ndarray]
    rounds: list[tuple[float, list[Tree]]]
    depth: int
    classes: int

    def margins(self) -> Column:
        """Array of the sum of the trees of each booster."""
        count = len(self.rounds[0][1])
        shared, depth, cuts = self.rounds, self.depth, self.cuts

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margin(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.vstack(x.to_numpy())
            codes = np.stack([np.searchsorted(c, m[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
            return pd.Series(list(_added(np.zeros((len(m), count)), codes, shared, depth)))

        return margin(F.array(*[_number(c) for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        out = df.select(*kept, self.margins().alias("_margin"))
        m, names = F.col("_margin"), [q(c) for c in df.columns if c not in ("prediction", "probability")]
        if self.task != "classification":
            return out.select(*names, m[0].alias("prediction"))
        if self.classes <= 2:
            p = 1.0 / (1.0 + F.exp(-2.0 * m[0]))
            return out.select(*names, (m[0] > 0).cast("double").alias("prediction"), F.array(1.0 - p, p).alias("probability"))
        # margins of one-vs-rest: logistic of each, normalised over the classes
        p = F.transform(m, lambda v: 1.0 / (1.0 + F.exp(-v)))
        total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
        best = (F.array_position(m, F.array_max(m)) - 1).cast("double")
        return out.select(*names, best.alias("prediction"), F.transform(p, lambda v: v / total).alias("probability"))

    def importance(self) -> list[tuple[str, float]]:
        """Mean over the trees of the share of the gain of each feature."""
        total = np.zeros(len(self.features))
        for rate, trees in self.rounds:
            for tree in trees:
                gain = np.bincount(np.maximum(tree.feature, 0), np.where(tree.feature >= 0, tree.gain, 0.0), len(total))
                total += rate * gain / gain.sum() if gain.sum() > 0 else 0.0
        return list(zip(self.features, [float(v) for v in total / (total.sum() or 1.0)]))


def fit_boosting(df: DataFrame, features: Sequence[str], label: str, task: str, classes: int, params: dict) -> Boosting:
    """`params` as `models.PARAMS` has them, without those of ROWWISE."""
    depth = int(params.get("max_depth") or 3)
    bins = int(params.get("max_bins") or 32)
    least = int(params.get("min_samples_leaf") or 1)
    least_gain = float(params.get("min_impurity_decrease") or 0.0)
    rate = float(params.get("learning_rate", 0.1))
    features, count = list(features), len(boosters(classes))
    width, spark = len(features), df.sparkSession
    cuts = thresholds(df, features, bins)
    bins = max(len(c) for c in cuts) + 1
    last = np.array([np.arange(bins) < len(c) for c in cuts])  # bins that end at a threshold
    rounds: list[tuple[float, list[Tree]]] = []
    with cached(_cells(df, features, label, classes, cuts)) as cells:
        tasks = max(1, min(kernel_tasks(spark), -(-cells.count() // CELLS_PER_TASK)))
        blocks = _blocks(cells.repartition(tasks), width, count).persist()
        blocks.count()
    fresh: list[tuple[float, list[Tree]]] = []  # rounds that the margins of the blocks lack
    try:
        for i in range(int(params.get("n_estimators", 100))):
            growing = [_new_tree(depth) for _ in range(count)]
            for level in range(depth):
                total = _level(blocks, level, width, bins, classes, count, fresh, growing, i == 0, depth)
                start, some = (1 << level) - 1, False
                for k, tree in enumerate(growing):
                    for node in range(1 << level):
                        _split(tree, start + node, total[0, k, node], total[1, k, node], last, least, least_gain)
                        some |= tree.feature[start + node] >= 0
                if not some:
                    break
            rounds.append((1.0 if i == 0 else rate, growing))
            fresh.append(rounds[-1])
            if len(fresh) == REFRESH:
                old, blocks = blocks, _refreshed(blocks, width, count, fresh, depth).persist()
                blocks.count()
                old.unpersist()
                fresh = []
    finally:
        blocks.unpersist()
    return Boosting("gradient_boosting", task, features, cuts, rounds, depth, classes)


def _refreshed(blocks: DataFrame, width: int, count: int, rounds: list, depth: int) -> DataFrame:
    rounds = list(rounds)

    def run(batches):
        for batch in batches:
            new = [_added(margin, codes, rounds, depth).tobytes() for codes, _, _, margin in _opened(batch, width, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, type=pa.binary())], names=["bins", "n", "y", "margin"])

    return blocks.mapInArrow(run, BLOCKS)
