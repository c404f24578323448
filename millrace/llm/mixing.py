"""Mixing documents to target weights with soft domain membership (operator 2).

A softmax classifier over hashed words, trained on labelled documents, gives
every document a posterior over domains.  Document i of n_i tokens and
posterior p_i gets a rate r_i >= 0, the expected number of times that it is
read, so that the expected tokens of each domain, sum_i r_i n_i p_i, match the
targets.  The rates minimise

    1/2 sum_d (sum_i r_i n_i p_id - T_d)^2 / N_d + e/2 sum_i n_i (r_i - 1)^2,    N_d = sum_i n_i p_id

with a vanishing e, which chooses, of all rates that fit, those nearest to 1.
Gradients are summed before they are projected: with the sum g of k numbers,

    r_i = max(0, 1 - sum_d p_id g_d),

and every step adds the present gradient in the metric of the documents that are
not at zero, a k x k matrix, with the best of eight step lengths.  Steps end at
the projected-gradient condition, some ten passes also where domains overlap;
each pass is one aggregation of a few hundred numbers over all documents, and a
rate follows from the k numbers alone, so no state is stored.  Targets that no
rates reach leave a miss, which `Mixture.miss` tells and a warning names.

Training reads one text of at most `max_rows` labelled ids (a documented bound),
as distinct slots with counts.

Defined results: a null or empty text has no tokens and a prior posterior, and
its rate counts all the same; domains without a target get target 0; targets of
domains that no label names are left out and the rest is scaled to sum to 1;
without labels all rates are 1; of an id with several texts the one with the
least hash trains.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .text import SPACE, U64, Words, list_column, sliced

BITS = 17
#: wanted shares of tokens; `low` is text labelled as of low quality in any language
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "low": 0.05}


@dataclass
class Domains:
    names: list[str]
    weights: np.ndarray  # slots x domains
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x domains, tokens of each text)."""
        w = Words(texts, SPACE, lower=True)
        slots = (w.hash >> U64(64 - BITS)).astype(np.int64)
        sums = np.zeros((len(slots) + 1, len(self.names)))
        np.cumsum(self.weights[slots], axis=0, out=sums[1:])
        tokens = w.counts()
        logits = (sums[w.ptr[1:]] - sums[w.ptr[:-1]]) / np.sqrt(np.maximum(tokens, 1))[:, None] + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), tokens


def _train(
    slots: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, names: list[str], epochs: int, rate: float
) -> Domains:
    k = len(names)
    weights, squares = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-2)
    share = np.bincount(labels, minlength=k) / max(1, len(labels))
    bias, target = np.log(np.maximum(share, 1e-6)), np.eye(k)
    for _ in range(epochs):
        for at, count, y in zip(slots, counts, labels):
            value = (count / np.sqrt(max(1, count.sum())))[:, None]
            logits = (weights[at] * value).sum(axis=0) + bias
            p = np.exp(logits - logits.max())
            g = p / p.sum() - target[y]
            step = value * g
            squares[at] += step * step
            weights[at] -= rate * step / np.sqrt(squares[at])
    return Domains(names, weights.astype(np.float32), bias)


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    max_rows: int = 3000,
    epochs: int = 3,
    rate: float = 0.1,
) -> Domains:
    """Train on docs with a row (id, domain) in `labelled`, the first max_rows by a hash of the id."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{domain_col}`").alias("domain"))
    rows = rows.where("id is not null and domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))
    sample = F.broadcast(rows.orderBy(F.xxhash64("id"), "id").limit(max_rows))  # bounded by max_rows
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text"):
            w = Words(batch.column("text"), SPACE, lower=True)
            hashed = (w.hash >> U64(64 - BITS)).astype(np.int32)
            found = [np.unique(hashed[a:b], return_counts=True) for a, b in zip(w.ptr[:-1], w.ptr[1:])]
            sizes = [len(f[0]) for f in found]
            lists = [list_column(np.concatenate([f[i] for f in found]).astype(np.int32), sizes) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("domain"), *lists], names=["k", "domain", "slots", "counts"]
            )

    # one text for each id, so that max_rows bounds what is gathered
    chosen = texts.join(sample, "id").groupBy("id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = chosen.select(F.xxhash64("id", "text").alias("k"), "domain", "text")
    got = chosen.mapInArrow(run, "k long, domain string, slots array<int>, counts array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return Domains(["all"], np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    order = np.argsort(got.column("k").to_numpy(), kind="stable")
    names, labels = np.unique(np.array(got.column("domain").to_pylist(), dtype=object), return_inverse=True)

    def lists(name: str) -> list[np.ndarray]:
        flat = got.column(name).combine_chunks()
        values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
        return [values[offsets[i] : offsets[i + 1]] for i in order]

    return _train(lists("slots"), lists("counts"), labels[order], names.tolist(), epochs, rate)


def rates(posteriors: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Rates for the summed gradients: the start minus them, projected."""
    return np.maximum(0.0, 1.0 - posteriors @ slopes)


def _passes(table: DataFrame, k: int, tries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each of the slopes: expected tokens of each domain, the metric (k x k) of documents
    not at zero, and half the sum of n_i r_i^2; in one aggregation."""

    def run(batches):
        total = np.zeros((len(tries), k + k * k + 1))
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(-1, k)
            n = batch.column("tokens").to_numpy()
            for i, slopes in enumerate(tries):
                r = rates(p, slopes)
                weighted = p * n[:, None]
                total[i] += np.concatenate([r @ weighted, (weighted[r > 0].T @ p[r > 0]).ravel(), [(r * r) @ n / 2]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    rows = table.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    found = np.zeros((len(tries), k + k * k + 1))  # bounded by the tries and domains
    for r in rows:
        found.flat[r["i"]] = r["x"]
    return [(f[:k], f[k:-1].reshape(k, k), f[-1]) for f in found]


@dataclass
class Mixture:
    """Rates are `rates(posteriors, slopes)`; `miss` is the largest remaining miss in shares of all tokens."""

    domains: Domains
    slopes: np.ndarray
    goal: np.ndarray
    reached: np.ndarray
    passes: int

    @property
    def miss(self) -> float:
        return float(np.abs(self.reached - self.goal).max() / max(self.goal.sum(), 1e-300))


#: how much the distance of rates from 1 counts, step by step
CLOSENESS = (1e-2, 1e-4, 1e-6)
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4)


def fit_rates(
    docs: DataFrame,
    domains: Domains,
    targets: dict[str, float],
    text_col: str = "text",
    tolerance: float = 1e-6,
    most_passes: int = 200,
) -> Mixture:
    """Steps until the projected gradient is below `tolerance` of all tokens.

    A fit that is not there after `most_passes` is an error; targets out of reach are not, but a warning.
    """
    k = len(domains.names)
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains.names])

    def run(batches):
        for batch in sliced(batches, "text"):
            p, tokens = domains.posteriors(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.int64()), list_column(p.ravel(), np.full(len(p), k))], names=["tokens", "p"]
            )

    with Scratch(docs.sparkSession) as scratch:
        texts = docs.select(F.col(f"`{text_col}`").alias("text"))
        table = scratch.write(texts.mapInArrow(run, "tokens long, p array<double>"), "posteriors")
        slopes, passes = np.zeros(k), 1
        scale, metric, value = _passes(table, k, [slopes])[0]
        reached, total = scale, max(scale.sum(), 1.0)
        goal = weight / weight.sum() * total if weight.sum() > 0 and scale.sum() > 0 else scale
        for close in CLOSENESS:
            own = close * np.maximum(scale, 1e-9 * total)
            while np.abs(gradient := goal - reached + own * slopes).max() > tolerance * total:
                if passes >= most_passes:
                    raise RuntimeError(f"rates are not there after {passes} passes")
                step = np.linalg.solve(metric + np.diag(own), gradient)
                tries = [slopes - length * step for length in LENGTHS]
                found = _passes(table, k, tries)
                costs = [f[2] + goal @ t + own @ (t * t) / 2 for f, t in zip(found, tries)]
                best = int(np.argmin(costs))
                if costs[best] >= value + goal @ slopes + own @ (slopes * slopes) / 2:
                    break  # no step lowers the objective any more: rounding
                slopes, (reached, metric, value), passes = tries[best], found[best], passes + 1
        fitted = Mixture(domains, slopes, goal, reached, passes)
        if fitted.miss > 1e-3:
            shares = ", ".join(f"{d} {x:.3f} of {y:.3f}" for d, x, y in zip(domains.names, reached / total, goal / total))
            warnings.warn(f"no rates reach the targets: {shares}", stacklevel=2)
        return fitted


def with_rates(docs: DataFrame, mixture: Mixture, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs and the columns domain (most likely), n_tokens and rate, each after `prefix`."""
    added = [f"{prefix}{c}" for c in ("domain", "n_tokens", "rate")]
    if set(added) & set(docs.columns):
        raise ValueError(f"columns {sorted(set(added) & set(docs.columns))} exist; choose another prefix")
    domains, slopes = mixture.domains, mixture.slopes

    def run(batches):
        names = np.array(domains.names, dtype=object)
        for batch in sliced(batches, text_col):
            p, tokens = domains.posteriors(batch.column(text_col))
            columns = [pa.array(names[p.argmax(axis=1)], pa.string()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns, pa.array(rates(p, slopes))], names=[*batch.schema.names, *added]
            )

    kinds = (T.StringType(), T.LongType(), T.DoubleType())
    fields = [T.StructField(n, t) for n, t in zip(added, kinds)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Domain of labelled documents: `low` for quality 0, the language for quality 1."""
    rows = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
    domain = F.when(F.col("quality") == 0, F.lit("low")).when(F.col("quality") == 1, F.col("lang"))
    return rows.select("doc_id", domain.alias("domain"))


def free_prefix(columns: list[str], prefix: str = "") -> str:
    """The given prefix, or as many times `mix_` as keep the added columns free."""
    while {f"{prefix}{c}" for c in ("domain", "n_tokens", "rate")} & set(columns):
        prefix = f"mix_{prefix}"
    return prefix


def mix_by_quality(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs (doc_id, text, lang, ...) with domain, n_tokens and rate for domains of `domain_labels`;
    where docs has a column of such a name, all three follow `free_prefix`."""
    domains = fit_domains(docs, domain_labels(docs, labels))
    return with_rates(docs, fit_rates(docs, domains, targets), prefix=free_prefix(docs.columns))
