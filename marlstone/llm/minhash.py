"""MinHash signatures and banding with recall tuned from the collision curve."""

from __future__ import annotations

import math
import zlib

import numpy as np


def collision(similarity: float, rows: int, bands: int) -> float:
    """Probability that two sets of the given Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` that find a pair of this similarity with the wanted recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


class Bands:
    def __init__(self, rows: int, bands: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = rows * bands
        self.rows, self.bands = rows, bands
        self.a = rng.integers(1, 1 << 31, n, dtype=np.uint64) * 2 + 1
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.seen: dict[str, int] = {}

    def _hash(self, gram: str) -> int:
        h = self.seen.get(gram)
        if h is None:
            raw = gram.encode()
            h = self.seen[gram] = (zlib.crc32(raw) << 32) | zlib.crc32(raw[::-1])
        return h

    def keys(self, gram_sets: list[set[str]]) -> np.ndarray:
        """(sets, bands) int64 band keys."""
        width = max((len(g) for g in gram_sets), default=1) or 1
        m = np.zeros((len(gram_sets), width), dtype=np.uint64)
        for i, g in enumerate(gram_sets):
            hs = [self._hash(x) for x in g] or [0]
            m[i, : len(hs)] = hs
            m[i, len(hs) :] = hs[0]
        out = np.empty((len(gram_sets), self.bands), dtype=np.int64)
        with np.errstate(over="ignore"):
            for band in range(self.bands):
                key = np.full(len(gram_sets), band * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
                for r in range(band * self.rows, (band + 1) * self.rows):
                    low = ((m * self.a[r] + self.b[r]) >> np.uint64(31)).min(axis=1)
                    key = (key ^ low) * np.uint64(0x100000001B3)
                    key ^= key >> np.uint64(29)
                out[:, band] = key.astype(np.int64)
        return out
