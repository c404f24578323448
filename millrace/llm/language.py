"""Language identification by averaged subword embeddings (operator 9).

The subwords of a text are the byte 3-, 4- and 5-grams of its words (each with
a mark at both ends), hashed into slots.  A text is the average of its
subwords' embeddings; a linear softmax gives the languages.  Embeddings and
softmax are trained together by stochastic gradient descent in numpy.  For
prediction the two linear maps are folded into one small table, so scoring is
one lookup for each subword, without a shuffle, over whole texts.

Scores are calibrated: the temperature of the softmax is fitted on documents
that were set aside, and the rejection threshold is the score below which at
most `keep` of those documents fall.

Training reads at most `max_rows` documents (a documented bound), the first in
the order of a hash of the id.

Defined results: a text that is null or has no letter is `und` with score 0,
whatever the model says; without training rows all are `und`; rows with the
same id are predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PUNCTUATION, U64, Words, list_column, mixed, sliced

BITS = 16
SIZES = (3, 4, 5)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every subword."""
    w = Words(texts, PUNCTUATION, lower=True)
    if not len(w.start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    # every word between two marks, words one after the other
    size = w.end - w.start + 2
    begin = np.cumsum(size) - size
    letters = np.full(int(size.sum()), 1, np.uint8)
    inside = np.arange(int((size - 2).sum())) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    letters[np.repeat(begin + 1, size - 2) + inside] = lower[w.data[np.repeat(w.start, size - 2) + inside]]
    word_of = np.repeat(np.arange(len(size)), size)
    text_of = np.repeat(np.arange(len(w.ptr) - 1), w.counts())
    slots, rows = [], []
    grams = letters.astype(U64)
    for n in range(2, max(SIZES) + 1):
        grams = grams[:-1] * U64(257) + letters[n - 1 :]
        if n not in SIZES or not len(grams):
            continue
        ok = word_of[: len(grams)] == word_of[n - 1 :]
        slots.append((mixed(grams[ok] + U64(n)) >> U64(64 - BITS)).astype(np.int32))
        rows.append(text_of[word_of[: len(grams)][ok]])
    return np.concatenate(slots), np.concatenate(rows)


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # slots x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        slots, rows = subwords(texts)
        n, k = len(texts), len(self.names)
        counts = np.maximum(np.bincount(rows, minlength=n), 1)
        sums = np.stack([np.bincount(rows, self.table[slots, j], minlength=n) for j in range(k)], axis=1)
        return _softmax((sums.reshape(n, k) / counts[:, None] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def train(
    examples: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    names: list[str],
    dim: int = 16,
    epochs: int = 5,
    rate: float = 0.5,
    keep: float = 0.02,
    seed: int = 7,
) -> Languages:
    """examples: (slots, counts) of each text; every tenth is set aside for calibration."""
    k = len(names)
    rng = np.random.default_rng(seed)
    embedding = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    target = np.eye(k, dtype=np.float32)
    aside = np.arange(len(labels)) % 10 == 9
    order = np.flatnonzero(~aside)
    steps, done = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            slots, counts = examples[i]
            if not len(slots):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            x = share @ embedding[slots]
            g = _softmax(x @ weights + bias) - target[labels[i]]
            now = rate * (1 - done / steps)
            back = weights @ g
            weights -= now * np.outer(x, g)
            bias -= 0.1 * now * g
            # rows are averages over hundreds of subwords, hence the larger step
            embedding[slots] -= (now * min(len(slots), 200)) * np.outer(share, back)
            done += 1
    model = Languages(names, embedding @ weights, bias)
    checks = [i for i in np.flatnonzero(aside) if len(examples[i][0])]
    if checks:
        logits = np.array([(e[1] / e[1].sum()) @ model.table[e[0]] + bias for e in (examples[i] for i in checks)])
        truth = labels[checks]
        grid = np.geomspace(0.05, 20, 60)
        # smoothed targets: a perfect score on few documents is no certainty
        soft = np.full((len(truth), k), 1 / (len(truth) + 2) / max(1, k - 1))
        soft[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
        loss = [-(soft * np.log(_softmax(logits / t) + 1e-300)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.reject_below = float(np.quantile(_softmax(logits / model.temperature).max(axis=1), keep))
    return model


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 3000,
    **options,
) -> Languages:
    """Train on rows of docs with a language; leave held-out rows out of `docs`."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).where("text is not null and lang is not null")
    # the ids come first, so that texts are not sorted; bounded by max_rows, hence the broadcast
    sample = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches):
        for batch in sliced(batches, "text"):
            slots, row = subwords(batch.column("text"))
            code, counts = np.unique(row << BITS | slots, return_counts=True)
            each = np.bincount(code >> BITS, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"),
                    batch.column("lang"),
                    list_column((code & ((1 << BITS) - 1)).astype(np.int32), each),
                    list_column(counts.astype(np.int32), each),
                ],
                names=["k", "lang", "slots", "counts"],
            )

    chosen = rows.join(F.broadcast(sample), "id").select(F.xxhash64("id", "text").alias("k"), "lang", "text")
    kind = "k long, lang string, slots array<int>, counts array<int>"
    got = chosen.mapInArrow(run, kind).toArrow().combine_chunks()
    if not got.num_rows:
        return Languages([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    order = np.argsort(got.column("k").to_numpy(), kind="stable")
    names, labels = np.unique(np.array(got.column("lang").to_pylist(), dtype=object), return_inverse=True)
    slots, counts = (got.column(c).combine_chunks() for c in ("slots", "counts"))
    at, values, times = slots.offsets.to_numpy(), slots.values.to_numpy(), counts.values.to_numpy()
    examples = [(values[at[i] : at[i + 1]], times[at[i] : at[i + 1]]) for i in order]
    return train(examples, labels[order], names.tolist(), **options)


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score, rejected), one for each row of docs."""
    text = F.col(f"`{text_col}`")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), letters.alias("letters"))

    def run(batches):
        names = np.array([*model.names, "und"], dtype=object)
        for batch in sliced(batches, "text"):
            ok = batch.column("letters").to_numpy(zero_copy_only=False)
            n = batch.num_rows
            best, top = np.full(n, len(model.names)), np.zeros(n)
            if model.names:
                p = model.probabilities(batch.column("text"))
                best, top = np.where(ok, p.argmax(axis=1), best), np.where(ok, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(names[best], pa.string()),
                    pa.array(top),
                    pa.array((top < model.reject_below) | (best == len(model.names))),
                ],
                names=["id", "lang_pred", "score", "rejected"],
            )

    fields = [
        T.StructField("id", source.schema["id"].dataType),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
