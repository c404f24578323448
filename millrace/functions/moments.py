"""Moment statistics under the two usual conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness_g1_unbiased(c: Column) -> Column:
    """Bias-corrected skewness G1; NULL for fewer than three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_g2_unbiased(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2; NULL for fewer than four values."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))
