"""Words, shingles and their hashes for many texts at once, in numpy.

A slice of an Arrow batch is one byte buffer; everything is computed over the
whole buffer.  Word separators and A-Z are single bytes in UTF-8, so cutting
and lower-casing bytes is the same as doing it to characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers drawn by a seed."""
    return mixed(np.arange(1, n + 1, dtype=U64) * U64(BASE) + U64(seed)) | U64(1)


def table_of(separators: bytes) -> np.ndarray:
    gaps = np.zeros(256, dtype=bool)
    gaps[list(separators)] = True
    return gaps


#: space and the control characters 9 to 13
SPACE = table_of(bytes([32, 9, 10, 11, 12, 13]))
#: every ASCII character that is neither a letter nor a digit
PUNCTUATION = table_of(bytes(b for b in range(128) if not chr(b).isalnum()))


def sliced(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where about `limit` bytes of text are full; a longer text is one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of consecutive texts: `hash` of each, byte `start` and `end`, and
    `ptr`: the words of text i are ptr[i] to ptr[i + 1]."""

    def __init__(self, texts: pa.Array, gaps: np.ndarray = SPACE, lower: bool = False):
        data, offsets = buffer_of(texts)
        n = len(data)
        inside = ~gaps[data]
        begins, ends = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            begins[1:] = inside[:-1]
            begins[offsets[:-1][offsets[:-1] < n]] = False
            ends[:-1] = inside[1:]
            ends[offsets[1:][offsets[1:] > 0] - 1] = False
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(inside & ~begins)
        self.end = np.flatnonzero(inside & ~ends) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        letters = constants(256, 11)
        if lower:
            letters[65:91] = letters[97:123]
        powers = np.empty(n, U64)
        if n:
            powers[0] = 1
            powers[1:] = U64(BASE)
            np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, U64)
        np.cumsum(letters[data] * powers, out=sums[1:])
        inverse = np.empty(n, U64)
        if n:
            inverse[0] = 1
            inverse[1:] = U64(pow(BASE, -1, 1 << 64))
            np.multiply.accumulate(inverse, out=inverse)
        length = (self.end - self.start).astype(U64)
        self.hash = mixed((sums[self.end] - sums[self.start]) * inverse[self.start] + length)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)


def ngrams(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of every n consecutive words, as if all texts were one."""
    if len(h) < n:
        return np.zeros(0, U64)
    weights = constants(n, seed * 1000 + n)
    out = h[: len(h) - n + 1] * weights[0]
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * weights[k]
    return mixed(out)


def shingle_sets(w: Words, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.  A text of fewer words has
    one shingle, its whole sequence; a text without words has none."""
    grams, out = ngrams(w.hash, width), []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(ngrams(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def list_column(values: np.ndarray, counts) -> pa.Array:
    """Arrow list column from flat values and the number in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
