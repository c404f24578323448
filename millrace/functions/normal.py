"""Standard normal quantile as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile
# (relative error below 1.15e-9).
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
     1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
     6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
     -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
     3.754408661907416e00]
LOW = 0.02425


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for k in coefficients[1:]:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: Column) -> Column:
    tail = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    outer = _poly(C, tail) / (_poly(D, tail) * tail + 1.0)
    mid = p - 0.5
    r = mid * mid
    inner = _poly(A, r) * mid / (_poly(B, r) * r + 1.0)
    return (
        F.when((p <= 0.0) | (p >= 1.0), F.lit(None).cast("double"))
        .when(p < LOW, outer)
        .when(p > 1.0 - LOW, -outer)
        .otherwise(inner)
    )


def normal_quantile_sql(p: str) -> str:
    """The same formula as SQL text, for oracles."""

    def poly(coefficients, x):
        out = f"({coefficients[0]!r})"
        for k in coefficients[1:]:
            out = f"({out}*{x}+({k!r}))"
        return out

    t = f"sqrt(-2*ln(least({p}, 1-{p})))"
    m = f"({p}-0.5)"
    r = f"({m}*{m})"
    outer = f"({poly(C, t)}/({poly(D, t)}*{t}+1.0))"
    inner = f"({poly(A, r)}*{m}/({poly(B, r)}*{r}+1.0))"
    return (
        f"CASE WHEN {p}<=0 OR {p}>=1 THEN NULL WHEN {p}<{LOW} THEN {outer} "
        f"WHEN {p}>{1 - LOW} THEN -{outer} ELSE {inner} END"
    )
