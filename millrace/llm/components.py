"""Connected components by alternating large-star and small-star steps.

Every step is a group-by with map-side combining and a join whose two sides
are plain scans, so that adaptive execution can split a hub's rows.  Nothing
is collected; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """edges (u, v), u > v.  Large: every larger neighbour of u moves to the
    smallest neighbour of u (u included).  Small: the same with the smaller ones."""
    rows = edges
    if large:
        rows = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = rows.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of ids -> (node, component): the smallest id that each node
    of an edge reaches; nodes without edges do not appear."""
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        if seen is not None and _is_forest(now):
            break
        seen = mark
        now = scratch.write(_star(scratch.write(_star(now, scratch, True), "large"), scratch, False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_forest(edges: DataFrame) -> bool:
    """True if every node points at one root and no root points on."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    worst = roles.groupBy("n").agg(F.sum("out").alias("o"), F.max("in").alias("i")).agg(
        F.max(F.when((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0)), 1).otherwise(0)).alias("bad")
    )
    return worst.first()["bad"] == 0
