"""64-bit hashes of the words of many texts at once.

A word is a longest run without space, tab, line feed, vertical tab, form feed
and carriage return; A-Z count as a-z.  Two words of one text, or of two
compared texts, collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Keeps the tables of powers between slices."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the first word of each text (and the end)."""
        buffers = texts.buffers()
        ends = np.frombuffer(buffers[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        low, n = int(ends[0]), int(ends[-1]) - int(ends[0])
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        if len(self.up) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            self.up, self.down = _powers(_STEP, size), _powers(_BACK, size)
        data = _LOWER[np.frombuffer(buffers[2], np.uint8)[low:low + n]]
        ends = ends.astype(np.int64) - low
        inside = ~_GAP[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = ends[:-1][ends[:-1] < n]
        begins[first] = inside[first]
        stops = np.empty(n, bool)
        stops[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
        stops[-1] = inside[-1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * self.up[:n], out=sums[1:])
        words = (sums[stop] - sums[start]) * self.down[start]
        words = mix(words + (stop - start).astype(np.uint64) * np.uint64(_STEP))
        return words, np.searchsorted(start, ends)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, sorted; of the whole text if
    it has fewer, and none if it has none."""
    if not len(words):
        return words
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total + words[k:len(words) - size + 1 + k]) * np.uint64(_STEP)
    return np.unique(total)
