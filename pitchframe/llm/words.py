"""Words and shingles of a batch of texts as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than space and the controls 0x09-0x0D, with A-Z
lowered. Its hash is a polynomial in the byte values modulo 2^64, read off one
running sum over the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


class Words:
    """``hashes`` of all words of a column of texts; those of text ``i`` are ``first[i]:first[i + 1]``.

    ``starts`` and ``ends`` are byte places in ``raw``, the bytes of all texts.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        size = int(offsets[-1] - offsets[0])
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        if not size:
            self.hashes, self.starts, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.first = np.zeros(n + 1, np.int64)
            return
        solid = ~_BLANK[self.raw]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        full = self.offsets[:-1] < self.offsets[1:]
        heads, tails = self.offsets[:-1][full], self.offsets[1:][full] - 1
        begins[heads], finishes[tails] = solid[heads], solid[tails]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        forward, backward = _power_tables(size + 1)
        running = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * forward[:size], out=running[1:])
        self.hashes = mix((running[self.ends] - running[self.starts]) * backward[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, self.offsets)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``width`` words and the first shingle of each text; a shorter text is one shingle as a whole."""
        words, counts = self.hashes, np.diff(self.first)
        at_each = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for i in range(width):
            at_each += words[i : i + len(at_each)] * _PLACE[i]
        at_each = mix(at_each)
        n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        out = np.zeros(len(where), np.uint64)
        inside = where < len(at_each)
        out[inside] = at_each[where[inside]]
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            own = words[self.first[i] : self.first[i + 1]]
            out[first[i]] = mix((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + _PLACE[32 + len(own)])[0]
        return out, first

    def shingle_letters(self, width: int) -> np.ndarray:
        """The bytes of the words of each shingle, in the order of :meth:`shingles`, which must all have ``width`` words or stand alone."""
        counts = np.diff(self.first)
        n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        running = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        return running[np.minimum(where + width, np.repeat(self.first[1:], n))] - running[where]
