"""Suffix order, Burrows-Wheeler transform and wavelet tree of word sequences."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Wavelet tree (level by level) with `rank(symbol, position)` for whole arrays."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.n = len(symbols)
        self.ones, self.zeros = [], []
        rows = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (rows >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            rows = np.concatenate([rows[bit == 0], rows[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(symbol), np.int64), position.astype(np.int64)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low


class FMIndex:
    """Index of a shard's sequences for patterns of up to `width` words.

    Suffixes are ordered by their first words (as many as the next power of
    two), which is enough for backward search of patterns of that length.
    `owner` gives each position of the text a number; `least_owner` answers the
    smallest one in a range of the suffix order.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int):
        self.width = width
        self.alphabet, coded = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        n = int(len(words) + len(lengths))
        text = np.zeros(n, np.int64)
        real = np.ones(n, bool)
        real[ends] = False
        text[real] = coded + 1  # 0 ends each sequence
        self.text, self.real = text, real
        step, key, half = 1, text, None
        while True:
            order = np.argsort(key, kind="stable")
            placed = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], placed[1:] != placed[:-1]]))
            if step <= width:
                half, covered = rank, step
            if step > width:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            step *= 2
        self.order = order
        self.symbols = len(self.alphabet) + 1
        before = text[order - 1]
        before[order == 0] = 0
        self.bwt = Wavelet(before, self.symbols)
        self.first = np.searchsorted(text[order], np.arange(self.symbols + 1))
        # where the first `width` words change along the suffix order
        left = np.repeat(ends, lengths + 1) - np.arange(n)  # words from here to the end of the sequence
        second = np.minimum(order + (width - covered), n - 1)
        cut = np.ones(n, bool)
        cut[1:] = (half[order[1:]] != half[order[:-1]]) | (half[second[1:]] != half[second[:-1]])
        cut[1:] |= left[order[:-1]] < width
        self.starts = np.flatnonzero(cut)
        self.owners = owner[order]
        self.least = [self.owners]
        while (1 << len(self.least)) <= n:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the range of each pattern with a word put before it."""
        base = self.first[symbol]
        return base + self.bwt.rank(symbol, low), base + self.bwt.rank(symbol, high)

    def widen(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of patterns longer than `width`, cut to their first `width` words."""
        at = np.searchsorted(self.starts, low, side="right")
        ends = np.append(self.starts, len(self.order))
        return self.starts[at - 1], ends[at]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.owners.dtype)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.least[k][low[m]], self.least[k][high[m] - (1 << int(k))])
        return out

    def matches(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Stream sequences through backward search, all in step, last word first.

        For each position of `words`: the smallest owner of an occurrence of the
        `width` words that start there, or the largest long where the matching
        statistic is less than `width`.
        """
        out = np.full(len(words), np.iinfo(np.int64).max, np.int64)
        at = np.searchsorted(self.alphabet, words)
        at = np.minimum(at, len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[at] == words, at + 1, -1)
        ends = np.cumsum(lengths)
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.order), np.int64)
        size = np.zeros(len(lengths), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero(lengths >= back)
            pos = ends[live] - back
            s = symbol[pos]
            known = s >= 0
            a, b = self.extend(np.maximum(s, 0), low[live], high[live])
            ok = known & (a < b)
            # a word that breaks the match is tried again on what follows it
            for j in np.flatnonzero(~ok):
                low[live[j]], high[live[j]], size[live[j]] = self._longest(symbol, pos[j], ends[live[j]])
            good = live[ok]
            low[good], high[good], size[good] = a[ok], b[ok], size[good] + 1
            long = good[size[good] > self.width]
            if len(long):
                low[long], high[long] = self.widen(low[long], high[long])
                size[long] = self.width
            full = live[size[live] == self.width]
            if len(full):
                out[ends[full] - back] = self.least_owner(low[full], high[full])
        return out

    def _longest(self, symbol: np.ndarray, pos: int, end: int) -> tuple[int, int, int]:
        """Range and length of the longest match (up to `width`) that starts at pos."""
        best = (0, len(self.order), 0)
        short, tall = 1, min(self.width, end - pos)
        while short <= tall:  # matches of a start are closed under shortening
            size = (short + tall) // 2
            low, high = np.zeros(1, np.int64), np.full(1, len(self.order), np.int64)
            for k in range(pos + size - 1, pos - 1, -1):
                if symbol[k] < 0:
                    high = low
                    break
                low, high = self.extend(symbol[k : k + 1], low, high)
                if low[0] >= high[0]:
                    break
            if low[0] < high[0]:
                best, short = (int(low[0]), int(high[0]), size), size + 1
            else:
                tall = size - 1
        return best
