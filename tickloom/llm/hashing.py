"""Hashes of word sequences inside tasks: cached word hashes, rolled over any range."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

#: Words whose hashes a task keeps.
MAX_CACHED_WORDS = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Byte table that lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    return h * np.uint64(0x94D049BB133111EB)


class Words(dict):
    """Word to its 64-bit hash; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 17)
        return value

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


class Rolling:
    """Hashes of any word ranges of a sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


def shingle_set(text: str | None, size: int, cache: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    rolled = Rolling(cache.of(words, len(words)))
    if len(words) <= size:
        return rolled.range(np.zeros(1, np.int64), np.array([len(words)])) + np.uint64(len(words))
    at = np.arange(len(words) - size + 1)
    return np.unique(rolled.range(at, at + size))
