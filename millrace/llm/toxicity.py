"""Toxicity by FTRL-proximal logistic regression (operator 3).

Features of a text are the distinct hashed slots of its words, word stems (the
first 5 and 7 bytes), word bigrams and skip-grams (one or two words apart).
FTRL-proximal keeps its own rate for each slot, and its L1 term leaves a few
thousand weights other than zero, which travel with the task.

Training reads at most `max_rows` labelled documents (a documented bound), the
first in the order of a hash of the id, so any partitioning gives the same
model.  Scoring is one pass without a shuffle over whole texts.

Defined results: a null or empty text has no features and scores by the bias;
labels that are null are ignored, of several labels of one id the largest
counts; rows with the same id are scored one by one; without labels of both
kinds every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import PUNCTUATION, U64, Words, constants, list_column, mixed, ngrams, sliced

BITS = 22


@dataclass
class FTRL:
    """Weights of the slots that are not zero."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -30.0


def _stems(w: Words, size: int) -> np.ndarray:
    """Hash of the first bytes of each word, A-Z lowered."""
    lower = np.arange(256, dtype=U64)
    lower[65:91] += U64(32)
    data = np.append(lower[w.data], np.zeros(size, U64))
    out = np.zeros(len(w.start), U64)
    for k in range(size):
        letter = np.where(w.start + k < w.end, data[w.start + k] + U64(1), U64(0))
        out = out * U64(0x100000001B3) + letter
    return mixed(out)


def occurrences(w: Words, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct (text << BITS | slot); with `wanted` only slots marked there."""
    text_of = np.repeat(np.arange(len(w.ptr) - 1, dtype=np.int64), w.counts())
    gap = constants(2, 77)
    h, found = w.hash, []
    kinds = [(h, 1), (_stems(w, 5), 1), (_stems(w, 7), 1), (ngrams(h, 2), 2)]
    for k, span in ((0, 3), (1, 4)):
        kinds.append((mixed(h[: -span + 1] * gap[k] + h[span - 1 :]), span))
    for seed, (values, span) in enumerate(kinds):
        slots = (mixed(values + U64(seed)) >> U64(64 - BITS)).astype(np.int64)
        rows = text_of[: len(slots)]
        ok = rows == text_of[span - 1 :][: len(slots)]
        if wanted is not None:
            ok &= wanted[slots]
        found.append(rows[ok] << BITS | slots[ok])
    return np.unique(np.concatenate(found))


def train(
    examples: list[np.ndarray],
    labels: np.ndarray,
    epochs: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 4.0,
    l2: float = 1e-3,
) -> FTRL:
    """FTRL-proximal over the examples in the order given."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return FTRL(bias=30.0 if share == 1 else -30.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rate = labels.mean()
    prior = float(np.log(rate / (1 - rate)))
    for _ in range(epochs):
        for slots, y in zip(examples, labels):
            zi, ni = z[slots], n[slots]
            w = weights(zi, ni)
            bias = prior - bz / ((beta + bn**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            root = np.sqrt(ni + g * g)
            z[slots] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[slots] = ni + g * g
            b = bias - prior
            bz, bn = bz + g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b, bn + g * g
    w = weights(z, n)
    keep = np.flatnonzero(w)
    bias = prior - bz / ((beta + bn**0.5) / alpha + l2)
    return FTRL(keep.astype(np.int32), w[keep].astype(np.float32), float(bias))


def predict(model: FTRL, texts: pa.Array) -> np.ndarray:
    table, wanted = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
    table[model.slots], wanted[model.slots] = model.weights, True
    return _predict(model.bias, table, wanted, texts)


def _predict(bias: float, table: np.ndarray, wanted: np.ndarray, texts: pa.Array) -> np.ndarray:
    found = occurrences(Words(texts, PUNCTUATION, lower=True), wanted)
    margin = np.bincount(found >> BITS, table[found & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(margin + bias, -30, 30)))


def held_out(id_col: Column, parts: int = 3, part: int = 1) -> Column:
    """True for ids whose labels are never learned from; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (id, label), the first by a hash of the id."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    rows = rows.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 8000,
    **options,
) -> FTRL:
    """Train on documents with a label; leave held-out labels out of `labels`."""
    sample = labelled_sample(labels, id_col, label_col, max_rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in sliced(batches, "text"):
            found = occurrences(Words(batch.column("text"), PUNCTUATION, lower=True))
            counts = np.bincount(found >> BITS, minlength=batch.num_rows)
            slots = (found & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("label"), list_column(slots, counts)], names=["k", "label", "slots"]
            )

    # bounded by max_rows, so it may be broadcast and its features collected
    rows = texts.join(F.broadcast(sample), "id").select(
        F.xxhash64("id", "text").alias("k"), F.col("label").cast("int").alias("label"), "text"
    )
    got = rows.mapInArrow(run, "k long, label int, slots array<int>").toArrow().combine_chunks()
    order = np.argsort(got.column("k").to_numpy(), kind="stable")
    flat = got.column("slots").combine_chunks() if got.num_rows else None
    labels_ = got.column("label").to_numpy()[order].astype(float)
    if flat is None:
        return train([], labels_)
    values, offsets = flat.values.to_numpy(), flat.offsets.to_numpy()
    return train([values[offsets[i] : offsets[i + 1]] for i in order], labels_, **options)


def score(docs: DataFrame, model: FTRL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each row of docs."""

    def run(batches):
        table, wanted = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
        table[model.slots], wanted[model.slots] = model.weights, True
        for batch in sliced(batches, "text"):
            p = _predict(model.bias, table, wanted, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], names=["id", "score"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: FTRL, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score `threshold` or more; no column is added."""

    def run(batches):
        table, wanted = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, bool)
        table[model.slots], wanted[model.slots] = model.weights, True
        for batch in sliced(batches, text_col):
            p = _predict(model.bias, table, wanted, batch.column(text_col))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
