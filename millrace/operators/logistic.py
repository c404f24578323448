"""Logistic regression by Newton steps on sums over the table.

A pass is one aggregation of the loss, the gradient and the Hessian blocks
(classes x features) for several step lengths at once; the small system is
solved on the driver.  The loss is the mean negative log-likelihood plus
`penalty` / 2 times the squared coefficients (not the intercepts): two classes
have one coefficient vector, more classes one for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: step lengths: the first alone, the others in one pass where it gains too little
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
#: parameters (classes x features) up to which Newton's system is formed
MOST_PARAMETERS = 400


@dataclass
class Softmax:
    """Weights (rows are classes; one row for two classes) and starts on `_features`, named as in MLlib's models."""

    weights: np.ndarray
    starts: np.ndarray
    passes: int
    gradient: float

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        return DenseMatrix(*self.weights.shape, self.weights.ravel().tolist(), True)

    @property
    def interceptVector(self) -> DenseVector:
        return Vectors.dense(self.starts)

    @property
    def coefficients(self) -> DenseVector:
        """Of two classes."""
        return Vectors.dense(self.weights[0])

    @property
    def intercept(self) -> float:
        return float(self.starts[0])

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `probability` (array) and `prediction`."""
        x = vector_to_array("_features")

        def margin(row, start):
            terms = F.zip_with(F.col("_x"), F.array(*[F.lit(float(v)) for v in row]), lambda a, b: a * b)
            return F.aggregate(terms, F.lit(float(start)), lambda s, v: s + v)

        margins = [margin(r, b) for r, b in zip(self.weights, self.starts)]
        if len(margins) == 1:
            margins = [-margins[0], margins[0]]
            parts = [1.0 / (1.0 + F.exp(-m)) for m in margins]
            out = df.withColumn("_x", x).withColumn("_p", F.array(*parts))
        else:
            out = df.withColumn("_x", x).withColumn("_m", F.array(*margins))
            out = out.withColumn("_e", F.transform("_m", lambda m: F.exp(m - F.array_max("_m"))))
            total = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)
            out = out.withColumn("_t", total).withColumn("_p", F.transform("_e", lambda e: e / F.col("_t"))).drop("_m", "_e", "_t")
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumnRenamed("_p", "probability").drop("_x")


def parameters(classes: int, features: int) -> int:
    return (1 if classes <= 2 else classes) * (features + 1)


def _pass(table: DataFrame, classes: int, width: int, middle, scale, tries: list[np.ndarray]) -> list[tuple]:
    """(loss, gradient, Hessian) sums for each of the parameters `tries` (rows x (width + 1))."""
    rows = 1 if classes <= 2 else classes
    size = rows * (width + 1)

    def run(batches):
        total = np.zeros((len(tries), 1 + size + size * size))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = (batch.column("x").flatten().to_numpy().reshape(-1, width) - middle) / scale
                x = np.hstack([x, np.ones((len(x), 1))])
                y = batch.column("y").to_numpy().astype(int)
                target = (y[:, None] == (np.arange(rows) if rows > 1 else 1)).astype(float)
                for i, theta in enumerate(tries):
                    m = x @ theta.T
                    if rows == 1:
                        loss = np.logaddexp(0, m[:, 0]) - target[:, 0] * m[:, 0]
                        p = np.exp(-np.logaddexp(0, -m))
                    else:
                        top = m.max(axis=1, keepdims=True)
                        e = np.exp(m - top)
                        loss = np.log(e.sum(axis=1)) + top[:, 0] - m[np.arange(len(m)), y]
                        p = e / e.sum(axis=1, keepdims=True)
                    hessian = np.zeros((rows, width + 1, rows, width + 1))
                    for a in range(rows):
                        for b in range(a, rows):
                            w = p[:, a] * ((a == b) - p[:, b])
                            hessian[a, :, b] = (x * w[:, None]).T @ x
                            hessian[b, :, a] = hessian[a, :, b].T
                    total[i] += np.concatenate([[loss.sum()], ((p - target).T @ x).ravel(), hessian.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    found = np.zeros((len(tries), 1 + size + size * size))  # bounded by MOST_PARAMETERS
    for r in table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        found.flat[r["i"]] = r["v"]
    return [(f[0], f[1 : 1 + size].reshape(rows, -1), f[1 + size :].reshape(size, size)) for f in found]


def fit_softmax(
    ready: DataFrame, label: str, classes: int, n: int, penalty: float, tolerance: float = 1e-10, most_passes: int = 50
) -> Softmax:
    """Fit on (`_features`, label) rows with classes 0 ... classes - 1.

    Steps end when no part of the gradient of the mean loss, in units of each
    feature's deviation, is above the tolerance, or no step lowers the loss any more.
    """
    table = ready.select(vector_to_array("_features").alias("x"), F.col(f"`{label}`").cast("double").alias("y"))
    width = len(table.select("x").first()["x"])
    moments = table.agg(
        F.array(*[F.avg(F.col("x")[j]) for j in range(width)]), F.array(*[F.stddev_pop(F.col("x")[j]) for j in range(width)])
    ).first()
    middle, scale = (np.array(m, dtype=float) for m in moments)
    if not (np.isfinite(middle).all() and np.isfinite(scale).all()):
        raise ValueError("logistic regression needs features without missing values")
    scale[scale == 0] = 1.0
    rows = 1 if classes <= 2 else classes
    weight = np.tile(np.concatenate([penalty / scale**2, [0.0]]), (rows, 1))
    theta, passes = np.zeros((rows, width + 1)), 1

    def whole(t, f):
        return f[0] / n + (weight * t * t).sum() / 2, f[1] / n + weight * t, f[2] / n + np.diag(weight.ravel())

    value, gradient, hessian = whole(theta, _pass(table, classes, width, middle, scale, [theta])[0])
    while np.abs(gradient).max() > tolerance and passes < most_passes:
        # intercepts of all classes may move together: the least step is taken
        step = np.linalg.lstsq(hessian, gradient.ravel(), rcond=1e-12)[0].reshape(theta.shape)
        tries = [theta - LENGTHS[0] * step]
        found = [whole(t, f) for t, f in zip(tries, _pass(table, classes, width, middle, scale, tries))]
        passes += 1
        # the whole step, unless it gains much less than the quadratic form promises
        if not value - found[0][0] >= 0.25 * (gradient * step).sum():
            more = [theta - s * step for s in LENGTHS[1:]]
            found += [whole(t, f) for t, f in zip(more, _pass(table, classes, width, middle, scale, more))]
            tries += more
            passes += 1
        best = int(np.argmin([f[0] for f in found]))
        if found[best][0] >= value:
            break
        theta, (value, gradient, hessian) = tries[best], found[best]
    weights = theta[:, :-1] / scale
    starts = theta[:, -1] - weights @ middle
    if rows > 1:
        starts = starts - starts.mean()
    return Softmax(weights, starts, passes, float(np.abs(gradient).max()))
