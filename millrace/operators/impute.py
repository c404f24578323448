"""Imputation from other columns: nearest neighbours and chained regressions."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import q
from ..session import cut_lineage
from .neighbors import nearest_rows


def impute_knn(df: DataFrame, row_id: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Fill each missing cell with the mean of the k nearest rows that have it.

    Distances skip missing coordinates and scale up by all/present ones.  A row
    that shares no coordinate with any donor gets the column mean.
    """
    holes = df.agg(*[F.count(F.when(q(c).isNull(), 1)).alias(c) for c in columns]).first()
    means = df.agg(*[F.avg(q(c).cast("double")).alias(c) for c in columns]).first()
    out = df
    todo = [c for c in columns if holes[c] and means[c] is not None]

    def neighbours(c: str) -> DataFrame:
        return nearest_rows(
            df.where(q(c).isNull()), df.where(q(c).isNotNull()), columns, row_id, row_id, k, payload=c
        )

    with ThreadPoolExecutor(max_workers=4) as pool:  # their small jobs overlap
        found = list(pool.map(neighbours, todo))
    for c, near in zip(todo, found):
        fill = near.groupBy(F.col("query_id").alias(row_id)).agg(F.avg("payload").alias("_fill"))
        out = (
            out.join(fill, row_id, "left")
            .withColumn(c, F.coalesce(q(c).cast("double"), F.col("_fill"), F.lit(means[c])))
            .drop("_fill")
        )
    return out.select(*[q(c) for c in df.columns])


def impute_iterative(
    df: DataFrame, columns: Sequence[str], rounds: int = 10, ridge: float = 1e-6, tol: float = 1e-3
) -> DataFrame:
    """Start from column means, then refit each column on the others in turn.

    One fit is one aggregate of cross products over the rows where the column
    was observed, solved as a small linear system; the table itself is only
    projected.  Lineage is cut once per round.
    """
    columns = list(columns)
    flags = {c: f"_missing_{c}" for c in columns}
    start = df.agg(*[F.avg(q(c).cast("double")).alias(c) for c in columns], *[
        F.count(F.when(q(c).isNull(), 1)).alias(flags[c]) for c in columns], *[
        F.max(F.abs(q(c).cast("double"))).alias(f"_top_{c}") for c in columns]).first()
    todo = sorted((c for c in columns if start[flags[c]] and start[c] is not None), key=lambda c: start[flags[c]])
    work = df.withColumns({flags[c]: q(c).isNull() for c in columns}).withColumns(
        {c: F.coalesce(q(c).cast("double"), F.lit(start[c])) for c in columns}
    )
    work = cut_lineage(work)
    limit = tol * max([start[f"_top_{c}"] or 0.0 for c in columns] or [0.0])
    for _ in range(rounds):
        moves = []
        for c in todo:
            others = [o for o in columns if o != c]
            # centred on the start means, which keeps the system well scaled
            terms = [F.lit(1.0)] + [q(o) - F.lit(start[o]) for o in others]
            y = q(c) - F.lit(start[c])
            sums = work.where(~q(flags[c])).agg(
                *[F.sum(terms[i] * terms[j]).alias(f"x{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))],
                *[F.sum(terms[i] * y).alias(f"y{i}") for i in range(len(terms))],
            ).first()
            m = len(terms)
            gram = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], dtype=float)
            penalty = ridge * np.trace(gram) / m * np.eye(m)
            penalty[0, 0] = 0.0
            beta = np.linalg.solve(gram + penalty, np.array([sums[f"y{i}"] for i in range(m)], dtype=float))
            guess = F.lit(start[c])
            for b, t in zip(beta, terms):
                guess = guess + F.lit(float(b)) * t
            work = work.withColumn(f"_old_{c}", q(c)).withColumn(c, F.when(q(flags[c]), guess).otherwise(q(c)))
            moves.append(F.max(F.abs(q(c) - q(f"_old_{c}"))).alias(c))
        if not todo:
            break
        work = cut_lineage(work)
        shift = work.agg(*moves).first()
        work = work.drop(*[f"_old_{c}" for c in todo])
        if max(shift[c] or 0.0 for c in todo) < limit:
            break
    return work.select(*[q(c) for c in df.columns])
