"""The exploratory report: several frames from one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import numeric_columns, q
from ..operators.association import correlation_matrix
from ..operators.distribution import histogram, target_distribution
from ..operators.profile import missing_report


def eda_report(
    df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Distributions, missing cells, correlations and the target distribution."""
    columns = list(columns if columns is not None else numeric_columns(df))
    out = {
        "distributions": histogram(df, columns),
        "missing": missing_report(df),
        "correlations": correlation_matrix(df, columns),
    }
    if target is not None:
        few = df.agg(F.count_distinct(q(target))).first()[0] < 20
        numeric = target in numeric_columns(df)
        task = "classification" if few or not numeric else "regression"
        out["target"] = target_distribution(df, target, task)
    return out
