"""Scalers with exact statistics, automatic choice per column and inverses.

A fit is a handful of aggregates whose results (a few numbers per column)
become literals, so a transform is one projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import exact_quantiles, numeric_columns, q, value_ranks
from ..functions.normal import normal_quantile
from .clean import fit_winsorizer
from .features import even_quantiles
from .profile import column_counts, iqr_bounds, per_column, per_column_outside

METHODS = (
    "standard minmax robust maxabs quantile_uniform quantile_normal power_yeo power_box normalizer none"
).split()
LEVELS = 1000


# ---- power transforms --------------------------------------------------------


def _power(base: Column, lam: Column, at_zero: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, at_zero).otherwise((F.pow(base, lam) - 1.0) / lam)


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    pos = _power(x + 1.0, lam, F.log1p(x))
    neg = -_power(1.0 - x, F.lit(2.0) - lam, F.log1p(-x))
    return F.when(x >= 0, pos).when(x < 0, neg)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    pos = F.expm1(y) if lam == 0 else F.pow(y * F.lit(lam) + 1.0, F.lit(1.0 / lam)) - 1.0
    neg = -F.expm1(-y) if lam == 2 else 1.0 - F.pow(1.0 - F.lit(2.0 - lam) * y, F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, pos).when(y < 0, neg)


def box_cox(x: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    x = F.when(x > 0, x)
    return _power(x, lam, F.log(x))


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * F.lit(lam) + 1.0, F.lit(1.0 / lam))


#: brackets of a power are doubled so often at most: up to 5 * 2**12
WIDENINGS = 12


def fit_lambda(df: DataFrame, columns: Sequence[str], kind: str, passes: int = 6) -> dict[str, float]:
    """Power by maximum likelihood: each pass scores a grid of powers for every
    column in one aggregate and zooms in tenfold around the best.  A best power
    at an end of its grid moves and doubles the bracket instead, so that the
    search has no bounds (columns of no spread keep 1)."""
    steps = 20
    left = {c: passes for c in columns}
    best = {c: 1.0 for c in columns}
    span = {c: (-5.0, 5.0) for c in columns}
    x, lam = F.col("x"), F.col("lo") + F.col("g") * F.col("step")
    y = yeo_johnson(x, lam) if kind == "yeo" else box_cox(x, lam)
    jacobian = F.signum(x) * F.log1p(F.abs(x)) if kind == "yeo" else F.log(x)
    for _ in range(passes + WIDENINGS):
        if not any(left.values()):
            break
        cells = [
            F.struct(
                F.lit(i).alias("i"),
                q(c).cast("double").alias("x"),
                F.lit(span[c][0]).alias("lo"),
                F.lit((span[c][1] - span[c][0]) / steps).alias("step"),
            )
            for i, c in enumerate(columns)
        ]
        known = df.select(F.inline(F.array(*cells))).where(x.isNotNull() if kind == "yeo" else x > 0)
        rows = (
            known.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("g"))
            .groupBy("i", "g")
            .agg(F.count(x).alias("n"), F.sum(jacobian).alias("j"), F.var_pop(y).alias("v"))
            .collect()  # columns x grid rows
        )
        top: dict[int, tuple[float, int]] = {}
        for r in rows:
            c = columns[r["i"]]
            at = span[c][0] + (span[c][1] - span[c][0]) / steps * r["g"]
            if r["v"] is None or not math.isfinite(r["v"]) or r["v"] <= 0:
                continue
            score = -r["n"] / 2.0 * math.log(r["v"]) + (at - 1.0) * r["j"]
            top[r["i"]] = max(top.get(r["i"], (-math.inf, 0)), (score, r["g"]))
        for i, (_, g) in top.items():
            c = columns[i]
            step = (span[c][1] - span[c][0]) / steps
            if not left[c]:
                continue
            best[c] = span[c][0] + step * g
            reach = steps * step if g in (0, steps) else step
            left[c] -= g not in (0, steps)
            span[c] = (best[c] - reach, best[c] + reach)
    return best


# ---- fitted columns ------------------------------------------------------------


@dataclass
class Fitted:
    """One scaled column: x → (f(x) - shift) / scale for a method-specific f."""

    method: str
    shift: float = 0.0
    scale: float = 1.0
    lam: float | None = None
    knots: list[float] = field(default_factory=list)
    low_ref: list[float] = field(default_factory=list)
    high_ref: list[float] = field(default_factory=list)

    def linear(self, x: Column) -> Column:
        return (x - F.lit(self.shift)) / F.lit(self.scale)

    def forward(self, x: Column) -> Column:
        x = x.cast("double")
        if self.method == "none":
            return x
        if self.method == "normalizer":
            return F.signum(x)
        if self.method == "power_yeo":
            return self.linear(yeo_johnson(x, self.lam))
        if self.method == "power_box":
            return self.linear(box_cox(x, self.lam))
        if self.method.startswith("quantile"):
            raise ValueError("quantile methods interpolate through a knot table")
        return self.linear(x)

    def inverse(self, y: Column) -> Column:
        if self.method in ("none", "normalizer"):
            return y
        if self.method.startswith("quantile"):
            raise ValueError("quantile methods interpolate through a knot table")
        z = y * F.lit(self.scale) + F.lit(self.shift)
        if self.method == "power_yeo":
            return yeo_johnson_inverse(z, self.lam)
        if self.method == "power_box":
            return box_cox_inverse(z, self.lam)
        return z


def _nonzero(v: float | None) -> float:
    return float(v) if v else 1.0


def fit_columns(df: DataFrame, methods: dict[str, str]) -> dict[str, Fitted]:
    """Fit every column with its method; columns without values are left out."""
    unknown = set(methods.values()) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown scaling methods {sorted(unknown)}")
    columns = list(methods)
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        aggs += [
            F.avg(x).alias(f"mean{i}"),
            F.stddev_pop(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.count(x).alias(f"n{i}"),
        ]
    row = df.agg(*aggs).first()
    stats = {
        c: {k: row[f"{k}{i}"] for k in ("mean", "std", "min", "max", "n")} for i, c in enumerate(columns)
    }
    columns = [c for c in columns if stats[c]["n"]]
    cuts = exact_quantiles(df, [c for c in columns if methods[c] == "robust"], [0.25, 0.5, 0.75])
    powers: dict[str, float] = {}
    for kind, method in (("yeo", "power_yeo"), ("box", "power_box")):
        chosen = [c for c in columns if methods[c] == method]
        if chosen:
            powers.update(fit_lambda(df, chosen, kind))
    moments = {}
    if powers:
        made = {
            c: yeo_johnson(q(c).cast("double"), lam) if methods[c] == "power_yeo" else box_cox(q(c).cast("double"), lam)
            for c, lam in powers.items()
        }
        r = df.agg(
            *[e for i, y in enumerate(made.values()) for e in (F.avg(y).alias(f"m{i}"), F.stddev_pop(y).alias(f"s{i}"))]
        ).first()
        moments = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(made)}
    out: dict[str, Fitted] = {}
    for c in columns:
        s, m = stats[c], methods[c]
        if m == "standard":
            out[c] = Fitted(m, s["mean"], _nonzero(s["std"]))
        elif m == "minmax":
            out[c] = Fitted(m, s["min"], _nonzero(s["max"] - s["min"]))
        elif m == "robust":
            lo, mid, hi = cuts[c]
            out[c] = Fitted(m, mid, _nonzero(hi - lo))
        elif m == "maxabs":
            out[c] = Fitted(m, 0.0, _nonzero(max(abs(s["min"]), abs(s["max"]))))
        elif m in ("power_yeo", "power_box"):
            mean, std = moments[c]
            out[c] = Fitted(m, mean or 0.0, _nonzero(std), lam=powers[c])
        elif m.startswith("quantile"):
            levels = max(2, min(LEVELS, s["n"]))
            out[c] = _quantile_fit(m, even_quantiles(df, c, levels))
        else:
            out[c] = Fitted(m)
    return out


def _quantile_fit(method: str, values: Sequence[float]) -> Fitted:
    last = len(values) - 1
    knots: list[float] = []
    low: list[float] = []
    high: list[float] = []
    for i, v in enumerate(values):
        if knots and v == knots[-1]:
            high[-1] = i / last
        else:
            knots.append(v)
            low.append(i / last)
            high.append(i / last)
    return Fitted(method, knots=knots, low_ref=low, high_ref=high)


def _interpolate(df: DataFrame, column: str, xs, left, right, output: str) -> DataFrame:
    """Piecewise linear map: xs[i] … xs[i+1] to right[i] … left[i+1]; exactly
    xs[i] to the middle of left[i] and right[i]; flat outside.

    The piece is found by binary search in the JVM and its ends come from a
    broadcast table of one row per knot (at most LEVELS).
    """
    x = q(column).cast("double")
    if len(xs) == 1:
        return df.withColumn(output, F.when(x < xs[0], F.lit(left[0])).when(x > xs[0], F.lit(right[0])).when(x.isNotNull(), F.lit((left[0] + right[0]) / 2)))
    names = df.columns
    ends = df.sparkSession.createDataFrame(
        [
            (float(i + 1), xs[i], xs[i + 1], (left[i] + right[i]) / 2, right[i], left[i + 1])
            for i in range(len(xs) - 1)
        ],
        "_piece double, _x0 double, _x1 double, _mid double, _y0 double, _y1 double",
    )
    cut = Bucketizer(
        splits=[-math.inf, *xs, math.inf], inputCol="_x", outputCol="_piece", handleInvalid="keep"
    )
    placed = cut.transform(df.withColumn("_x", x)).join(F.broadcast(ends), "_piece", "left")
    t = F.col("_x")
    y = (
        F.when(t <= xs[0], F.lit(left[0]))
        .when(t >= xs[-1], F.lit(right[-1]))
        .when(t == F.col("_x0"), F.col("_mid"))
        .otherwise(F.col("_y0") + (t - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")))
    )
    return placed.select(*[q(c) for c in names if c != output], y.alias(output))


@dataclass
class Scaler:
    fitted: dict[str, Fitted]

    def _apply(self, df: DataFrame, simple, through_knots) -> DataFrame:
        names = df.columns
        for c, f in self.fitted.items():
            if f.method.startswith("quantile") and c in names:
                df = through_knots(df, c, f)
        return df.select(
            *[
                simple(self.fitted[c], q(c)).alias(c)
                if c in self.fitted and not self.fitted[c].method.startswith("quantile")
                else q(c)
                for c in names
            ]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        def knots(df, c, f):
            df = _interpolate(df, c, f.knots, f.low_ref, f.high_ref, "_u")
            u = F.col("_u")
            if f.method == "quantile_normal":
                inner = F.greatest(F.least(u, F.lit(1 - 1e-7)), F.lit(1e-7))
                df = df.withColumn("_u", F.when(u.isNotNull(), inner))
                return df.withColumn(c, normal_quantile(u)).drop("_u")
            return df.withColumn(c, u).drop("_u")

        return self._apply(df, Fitted.forward, knots)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Undo every invertible method (the sign form of `normalizer` is not).
        Normal scores go through the error function in a vectorised kernel,
        since Spark has no normal CDF."""

        def knots(df, c, f):
            if f.method == "quantile_normal":
                df = df.withColumn(c, _normal_cdf()(q(c)))
            value_at = {}
            for k, lo, hi in zip(f.knots, f.low_ref, f.high_ref):
                value_at[lo] = value_at[hi] = k
            refs = sorted(value_at)
            values = [value_at[r] for r in refs]
            return _interpolate(df, c, refs, values, values, "_v").withColumn(c, F.col("_v")).drop("_v")

        return self._apply(df, Fitted.inverse, knots)


def _normal_cdf():
    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), na_action="ignore")

    return cdf


# ---- looking at distributions ------------------------------------------------------


def skew_z(g1: float, n: int) -> float:
    """Normal score of a sample skewness (D'Agostino 1970)."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    return math.asinh(y / math.sqrt(2.0 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))


def kurtosis_z(g2: float, n: int) -> float:
    """Normal score of a sample excess kurtosis (Anscombe and Glynn 1983)."""
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3.0 - mean) / math.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    t = math.copysign(((1 - 2 / a) / abs(d)) ** (1 / 3), d) if d else 0.0
    return (1 - 2 / (9 * a) - t) / math.sqrt(2 / (9 * a))


def normality(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """K² of D'Agostino and Pearson with its p-value, from one aggregate."""
    row = df.agg(
        *[
            e
            for i, c in enumerate(columns)
            for e in (
                F.count(q(c)).alias(f"n{i}"),
                F.skewness(q(c).cast("double")).alias(f"s{i}"),
                F.kurtosis(q(c).cast("double")).alias(f"k{i}"),
            )
        ]
    ).first()
    out = {}
    for i, c in enumerate(columns):
        n, g1, g2 = row[f"n{i}"], row[f"s{i}"], row[f"k{i}"]
        if n < 20 or g1 is None or g2 is None or math.isnan(g1) or math.isnan(g2):
            out[c] = (math.nan, math.nan)
        else:
            k2 = skew_z(g1, n) ** 2 + kurtosis_z(g2, n) ** 2
            out[c] = (k2, math.exp(-k2 / 2.0))
    return out


def kolmogorov_p(d: float, n: int) -> float:
    """Two-sided tail of the Kolmogorov statistic (asymptotic series)."""
    t = d * math.sqrt(n)
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (i - 1) * math.exp(-2.0 * i * i * t * t) for i in range(1, 101))))


def uniformity(df: DataFrame, column: str) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance to the uniform over [min, max], and its p."""
    x = q(column).cast("double")
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n or lo == hi:
        return math.nan, math.nan
    ranks = value_ranks(df.select(x.alias(column)), column)
    cdf = (F.col("value") - F.lit(lo)) / F.lit(hi - lo)
    above = (F.col("before") + F.col("n")) / F.lit(n) - cdf
    below = cdf - F.col("before") / F.lit(n)
    d = ranks.agg(F.max(F.greatest(above, below))).first()[0]
    return d, kolmogorov_p(d, n)


def distribution_tests(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """normal, uniform, other or unknown, judged on the values inside 1.5 IQR."""
    bounds = iqr_bounds(df, columns, 1.5)
    inside = df.select(
        *[
            F.when((q(c) >= F.lit(bounds[c][0])) & (q(c) <= F.lit(bounds[c][1])), q(c).cast("double")).alias(c)
            for c in columns
        ]
    )
    out = {}
    for c, (k2, p) in normality(inside, columns).items():
        if math.isnan(k2):
            n = inside.agg(F.count(q(c))).first()[0]
            out[c] = "unknown" if n < 20 else "other"
        elif p > 0.05:
            out[c] = "normal"
        else:
            out[c] = "uniform" if uniformity(inside, c)[1] > 0.05 else "other"
    return out


def analyze_columns(df: DataFrame, columns: Sequence[str] | None = None, test: bool = True) -> DataFrame:
    """Skewness, kurtosis, 3-IQR outliers, signs, unique ratio, distribution."""
    columns = list(columns if columns is not None else numeric_columns(df))
    shape = per_column(
        df,
        columns,
        {
            "n": F.count,
            "skewness": lambda c: F.skewness(c.cast("double")),
            "kurtosis": lambda c: F.kurtosis(c.cast("double")),
            "has_negative": lambda c: F.coalesce(F.bool_or(c < 0), F.lit(False)),
            "has_zero": lambda c: F.coalesce(F.bool_or(c == 0), F.lit(False)),
        },
    )
    outside = per_column_outside(df, columns, iqr_bounds(df, columns, 3.0)).select(
        "column_name", (F.col("outliers") > 0).alias("has_outliers")
    )
    unique = column_counts(df, columns).select("column_name", "n_unique")
    kind = F.lit(None).cast("string")
    if test:
        for c, t in distribution_tests(df, columns).items():
            kind = F.when(F.col("column_name") == c, t).otherwise(kind)
    # all sides have one row per column
    return (
        shape.where("n > 0")
        .join(F.broadcast(outside), "column_name")
        .join(F.broadcast(unique), "column_name")
        .select(
            "column_name",
            "skewness",
            "kurtosis",
            "has_outliers",
            "has_negative",
            "has_zero",
            (F.col("n_unique").cast("double") / F.col("n")).alias("unique_ratio"),
            kind.alias("distribution"),
        )
    )


def choice(handle_outliers: bool = True) -> Column:
    """Scaling method for a row of `analyze_columns`."""
    skewed = F.abs("skewness") > 2
    return (
        F.when(F.lit(handle_outliers) & F.col("has_outliers"), "robust")
        .when(F.col("unique_ratio") < 0.05, "minmax")
        .when(skewed & F.col("has_negative"), "power_yeo")
        .when(skewed & ~F.col("has_zero"), "power_box")
        .when(skewed, "quantile_normal")
        .when(F.col("distribution") == "uniform", "minmax")
        .otherwise("standard")
    )


def choose_methods(df: DataFrame, columns: Sequence[str] | None = None, handle_outliers: bool = True) -> dict[str, str]:
    rows = analyze_columns(df, columns).select("column_name", choice(handle_outliers).alias("method")).collect()
    return {r["column_name"]: r["method"] for r in rows}


def fit_scaler(
    df: DataFrame,
    methods: dict[str, str] | str = "auto",
    exclude: Sequence[str] = (),
    handle_outliers: bool = True,
) -> Scaler:
    """`methods` is one method for all numeric columns, `auto`, or a mapping."""
    columns = [c for c in numeric_columns(df) if c not in exclude]
    if methods == "auto":
        chosen = choose_methods(df, columns, handle_outliers)
    elif isinstance(methods, str):
        chosen = {c: methods for c in columns}
    else:
        chosen = {c: m for c, m in methods.items() if c not in exclude}
    return Scaler(fit_columns(df, chosen))


def fit_group_scaler(df: DataFrame, groups: dict[str, Sequence[str]], default: str = "standard") -> Scaler:
    """method → columns; numeric columns in no group get the default."""
    chosen = {c: m for m, columns in groups.items() for c in columns}
    for c in numeric_columns(df):
        chosen.setdefault(c, default)
    return Scaler(fit_columns(df, {c: m for c, m in chosen.items() if m != "none"}))


@dataclass
class WinsorScaler:
    """Clip to fitted percentiles, then standardise."""

    clipper: object
    scaler: Scaler

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self.clipper.transform(df))


def fit_winsor_scaler(df: DataFrame, columns: Sequence[str], limits=(0.05, 0.95)) -> WinsorScaler:
    clipper = fit_winsorizer(df, columns, limits)
    clipped = clipper.transform(df)
    return WinsorScaler(clipper, Scaler(fit_columns(clipped, {c: "standard" for c in columns})))


def normalize_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide the chosen columns of each row by their Euclidean norm."""
    total = F.lit(0.0)
    for c in columns:
        total = total + q(c).cast("double") * q(c).cast("double")
    norm = F.when(total == 0, F.lit(1.0)).otherwise(F.sqrt(total))
    return df.select(*[(q(c) / norm).alias(c) if c in columns else q(c) for c in df.columns])


def recommend_scaling(df: DataFrame, family: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(scope, method, reason): one `global` row and one row per column."""
    facts = analyze_columns(df, columns)
    if family == "tree":
        overall = F.lit("none"), F.lit("trees do not depend on scale")
    elif family == "neural":
        overall = F.lit("minmax"), F.lit("inputs between 0 and 1 suit networks")
    elif family == "linear":
        some = F.bool_or("has_outliers")
        overall = (
            F.when(some, "robust").otherwise("standard"),
            F.when(some, "outliers would dominate a linear fit").otherwise(
                "no outliers to guard against"
            ),
        )
    else:
        overall = F.lit("auto"), F.lit("each column by its own distribution")
    first = facts.agg(F.lit("global").alias("scope"), overall[0].alias("method"), overall[1].alias("reason"))
    each = facts.select(
        F.col("column_name").alias("scope"), choice().alias("method"), F.lit("column distribution").alias("reason")
    )
    return first.unionByName(each)


def scaling_report(df: DataFrame, scaler: Scaler) -> DataFrame:
    """Method, mean, std (ddof 1), range text and outlier flag of each source column."""
    columns = list(scaler.fitted)
    stats = per_column(
        df,
        columns,
        {
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
            "lo": lambda c: F.min(c.cast("double")),
            "hi": lambda c: F.max(c.cast("double")),
        },
    )
    outside = per_column_outside(df, columns, iqr_bounds(df, columns, 3.0)).select(
        "column_name", (F.col("outliers") > 0).alias("has_outliers")
    )
    method = F.lit(None).cast("string")
    for c, f in scaler.fitted.items():
        method = F.when(F.col("column_name") == c, f.method).otherwise(method)
    return stats.join(F.broadcast(outside), "column_name").select(
        "column_name",
        method.alias("method"),
        "mean",
        "std",
        F.format_string("[%.2f, %.2f]", "lo", "hi").alias("range"),
        "has_outliers",
    )
