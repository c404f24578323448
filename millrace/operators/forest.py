"""Random forests and single trees on counted cells.

The method and its defaults are MLlib's: thresholds at quantiles, trees by Gini
impurity or variance, Poisson bags, a random set of features at each node.  A
tree sees a row only by the bins of its features and its label, so equal ones
are one unit of n rows, whose weight in a bag is Poisson(n).  Weights are drawn
anew in each pass from the block's seed, so none are kept.  All trees grow side
by side: a pass over the blocks returns the sums of one level, which meet by
tree and node, and only the splits go to the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dist import q
from ..session import cached, kernel_tasks
from .boosting import DEEPEST, Tree, _number, binned, thresholds

SEED = 42
#: units of a block, and weights that a task draws in a pass
BLOCK_UNITS = 262_144
TASK_WEIGHTS = 400_000
BLOCKS = "cells binary, start binary, n binary, y binary"
SUMS = "tree int, node int, sums binary"
SPLITS = "tree int, node int, feature int, cut int, gain double, value array<double>, left array<double>, right array<double>"
CRITERIA = {"classification": (None, "gini"), "regression": (None, "variance", "squared_error")}


def features_of_node(given, width: int, trees: int, task: str) -> int | None:
    """Number of features that a node looks at, by MLlib's names; None if the name is unknown."""
    if given == "auto":
        given = "all" if trees == 1 else "sqrt" if task == "classification" else "onethird"
    named = {None: width, "all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
    if given in named:
        return named[given]
    try:
        number = float(given)
    except (TypeError, ValueError):
        return None
    if number > 0 and str(given).isdigit():
        return min(int(number), width)
    return math.ceil(number * width) if 0 < number <= 1 else None


def handles(params: dict, task: str, width: int) -> bool:
    """Other criteria and deeper trees are MLlib's."""
    known = features_of_node(params.get("max_features", "auto"), width, int(params.get("n_estimators", 100)), task)
    return known is not None and params.get("criterion") in CRITERIA[task] and int(params.get("max_depth") or 5) <= DEEPEST


def _units(df: DataFrame, features: Sequence[str], label: str, cuts: list[np.ndarray], merge: bool) -> DataFrame:
    """(bins, y, n): rows with the same bins and label; without bags only sums count, so labels of a cell become their mean."""
    rows = binned(df, features, label, cuts)
    if merge:
        return rows.groupBy("bins").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("n"))
    return rows.groupBy("bins", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _blocks(units: DataFrame, width: int) -> DataFrame:
    """Units, ordered by cell, as matrices of bounded size: bins of the cells, the first unit of each, n and y of the units."""

    def pack(batches):
        held, size = [], 0

        def block():
            bins, n, y = (np.concatenate(part) for part in zip(*held))
            start = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]).any(axis=1)))
            parts = (bins[start], start, n, y)
            return pa.RecordBatch.from_arrays([pa.array([m.tobytes()], type=pa.binary()) for m in parts], names=["cells", "start", "n", "y"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("bins").flatten().to_numpy().reshape(-1, width), b.column("n").to_numpy(), b.column("y").to_numpy()))
            size += b.num_rows
            if size >= BLOCK_UNITS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return units.select("bins", "n", "y").mapInArrow(pack, BLOCKS)


def _weights(n: np.ndarray, seed: int, tree: int, bag: tuple[bool, float]) -> np.ndarray:
    """Rows of each unit in the bag of a tree."""
    replace, rate = bag
    rng = np.random.default_rng([SEED, seed, tree])
    if replace:
        return rng.poisson(rate * n if n.max() > 1 else rate, len(n)).astype(float)
    return n if rate >= 1 else rng.binomial(n.astype(np.int64), rate).astype(float)


def _best(n: np.ndarray, s: np.ndarray, last: np.ndarray, least: int, least_gain: float):
    """Place (feature of the node, cut) and gain of the best split, or none; n is features x bins, s has one more axis ahead."""
    rows, whole = n[0].sum(), s[:, 0].sum(axis=1)
    left_n, left_s = np.cumsum(n, axis=1), np.cumsum(s, axis=2)
    right_n, right_s = rows - left_n, whole[:, None, None] - left_s
    able = (left_n >= least) & (right_n >= least) & (left_n > 0) & (right_n > 0) & last
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((left_s**2).sum(axis=0) / left_n + (right_s**2).sum(axis=0) / right_n - (whole**2).sum() / rows) / rows
    gain = np.where(able & (gain >= least_gain), gain, -np.inf)
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    # differences of rounding are no gain
    if not gain[j, b] > 1e-14 * max(((whole / rows) ** 2).sum(), 1e-300):
        return None
    return int(j), int(b), float(gain[j, b] * rows), left_s[:, j, b] / left_n[j, b], right_s[:, j, b] / right_n[j, b]


def _level(blocks: DataFrame, level: int, width: int, bins: int, classes: int, growing: dict[int, Tree], chosen: np.ndarray, bag, last, least: int, least_gain: float):
    """Splits of the nodes of one level; `chosen` (tree, node, i) are the features of each node."""
    nodes, some, sides = 1 << level, chosen.shape[2], max(classes, 1)
    first = nodes - 1
    open_ = {t: tree for t, tree in growing.items() if level == 0 or (tree.feature[(first - 1) // 2 : first] >= 0).any()}
    if not open_:
        return []

    def run(batches):
        total = {t: np.zeros((1 + sides, nodes, some, bins)) for t in open_}
        for batch in batches:
            for row in batch.to_pylist():
                cells, start = np.frombuffer(row["cells"], dtype=np.int16).reshape(-1, width), np.frombuffer(row["start"], dtype=np.int64)
                n, y = np.frombuffer(row["n"]), np.frombuffer(row["y"])
                seed = zlib.crc32(row["y"], zlib.crc32(row["cells"]))
                shares = [y == k for k in range(classes)] or [y]
                for t, tree in open_.items():
                    w = _weights(n, seed, t, bag)
                    sums = [np.add.reduceat(w, start), *(np.add.reduceat(w * share, start) for share in shares)]
                    node = tree.leaves(cells, level) - first
                    live = np.flatnonzero((node >= 0) & (sums[0] > 0))
                    at, picked, sums = node[live], chosen[t, node[live]], [x[live] for x in sums]
                    for i in range(some):
                        place = at * bins + cells[live, picked[:, i]]
                        for k, x in enumerate(sums):
                            total[t][k, :, i] += np.bincount(place, x, nodes * bins).reshape(nodes, bins)
        for t, sums in total.items():
            at = np.flatnonzero(sums[0, :, 0].sum(axis=1) > 0)
            if len(at):
                parts = [pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array([sums[:, i].tobytes() for i in at], type=pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["tree", "node", "sums"])

    def meet(batches):
        total: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                sums = np.frombuffer(r["sums"]).reshape(1 + sides, some, bins)
                key = (r["tree"], r["node"])
                total[key] = total[key] + sums if key in total else sums
        rows = []
        for (t, node), sums in total.items():
            found = _best(sums[0], sums[1:], last[chosen[t, node]], least, least_gain)
            j, cut, gain, left, right = found or (-1, 0, 0.0, np.zeros(sides), np.zeros(sides))
            value = sums[1:, 0].sum(axis=1) / sums[0, 0].sum()
            feature = int(chosen[t, node, j]) if found else -1
            rows.append((t, first + node, feature, cut, gain, value.tolist(), left.tolist(), right.tolist()))
        if rows:
            names = ["tree", "node", "feature", "cut", "gain", "value", "left", "right"]
            kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.list_(pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), kinds)], names=names)

    tasks = max(1, min(kernel_tasks(blocks.sparkSession), len(open_) * nodes // 8))
    return blocks.mapInArrow(run, SUMS).repartition(tasks, "tree", "node").mapInArrow(meet, SPLITS).collect()


def _prune(tree: Tree) -> None:
    """As MLlib does, undo splits into two leaves with one prediction."""
    guess = tree.value.argmax(axis=1) if tree.value.shape[1] > 1 else tree.value[:, 0]
    for node in range(len(tree.feature) // 2 - 1, -1, -1):
        left, right = 2 * node + 1, 2 * node + 2
        if tree.feature[node] >= 0 and tree.feature[left] < 0 and tree.feature[right] < 0 and guess[left] == guess[right]:
            tree.feature[node], tree.gain[node] = -1, 0.0


@dataclass
class Forest:
    """Fitted trees; a node's value is the mean label, or the share of each class."""

    name: str
    task: str
    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]
    depth: int
    classes: int

    def means(self) -> Column:
        """Mean over the trees of the values of a row's leaves."""
        trees, depth, cuts = self.trees, self.depth, self.cuts

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def mean(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.vstack(x.to_numpy())
            codes = np.stack([np.searchsorted(c, m[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
            return pd.Series(list(sum(tree.predict(codes, depth) for tree in trees) / len(trees)))

        return mean(F.array(*[_number(c) for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [q(c) for c in df.columns if c not in ("prediction", "probability")]
        out, m = df.select(*kept, self.means().alias("_mean")), F.col("_mean")
        if self.task != "classification":
            return out.select(*kept, m[0].alias("prediction"))
        best = (F.array_position(m, F.array_max(m)) - 1).cast("double")
        return out.select(*kept, best.alias("prediction"), m.alias("probability"))

    def importance(self) -> list[tuple[str, float]]:
        """Mean over the trees of the share of the gain of each feature."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            gain = np.bincount(np.maximum(tree.feature, 0), np.where(tree.feature >= 0, tree.gain, 0.0), len(total))
            total += gain / gain.sum() if gain.sum() > 0 else 0.0
        return list(zip(self.features, [float(v) for v in total / (total.sum() or 1.0)]))


def fit_forest(df: DataFrame, name: str, features: Sequence[str], label: str, task: str, classes: int, params: dict) -> Forest:
    """`params` as `models.PARAMS` has them; a decision tree is one tree of all rows and features."""
    features, spark, single = list(features), df.sparkSession, name == "decision_tree"
    width, sides = len(features), max(classes, 1)
    count = 1 if single else int(params.get("n_estimators", 100))
    depth = int(params.get("max_depth") or 5)
    bins = int(params.get("max_bins") or 32)
    least, least_gain = int(params.get("min_samples_leaf") or 1), float(params.get("min_impurity_decrease") or 0.0)
    some = width if single else features_of_node(params.get("max_features", "auto"), width, count, task)
    rate = 1.0 if single or params.get("max_samples") is None else float(params["max_samples"])
    replace = not single and params.get("bootstrap") is not False
    cuts = thresholds(df, features, bins)
    bins = max(len(c) for c in cuts) + 1
    last = np.array([np.arange(bins) < len(c) for c in cuts])  # bins that end at a threshold
    whole = not replace and rate >= 1
    with cached(_units(df, features, label, cuts, whole and task != "classification")) as units:
        tasks = max(1, min(kernel_tasks(spark), -(-units.count() * count // TASK_WEIGHTS)))
        # ranges of cells, cut by label where a cell is large
        ordered = units.repartitionByRange(tasks, "bins", "y").sortWithinPartitions("bins", "y")
        blocks = _blocks(ordered, width).persist()
        blocks.count()
    size = (1 << (depth + 1)) - 1
    trees = {t: Tree(np.full(size, -1), np.zeros(size, dtype=int), np.zeros((size, sides)), np.zeros(size)) for t in range(count)}
    rng = np.random.default_rng(SEED)
    try:
        for level in range(max(depth, 1)):
            # every node has its own features
            chosen = np.argsort(rng.random((count, 1 << level, width)), axis=2)[:, :, :some]
            splits = _level(blocks, level, width, bins, classes, trees, np.sort(chosen, axis=2), (replace, rate), last, least, least_gain)
            if level == 0:  # a bag may hold no row
                trees = {t: tree for t, tree in trees.items() if t in {r["tree"] for r in splits}}
            for r in splits:
                tree, node = trees[r["tree"]], r["node"]
                tree.value[node] = r["value"]
                if r["feature"] >= 0 and level < depth:
                    tree.feature[node], tree.cut[node], tree.gain[node] = r["feature"], r["cut"], r["gain"]
                    tree.value[2 * node + 1], tree.value[2 * node + 2] = r["left"], r["right"]
            if all(r["feature"] < 0 for r in splits):
                break
    finally:
        blocks.unpersist()
    if not trees:
        return fit_forest(df, name, features, label, task, classes, {**params, "bootstrap": False, "max_samples": None})
    for tree in trees.values():
        _prune(tree)
    return Forest(name, task, features, cuts, list(trees.values()), depth, classes)
