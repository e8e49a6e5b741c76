"""Words of a text as numbers, and hashes of runs of words, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class WordHashes(dict):
    """64-bit hash of each word; starts anew when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of all words as one run if there are fewer; nothing without words."""
    n = len(hashes)
    size = min(size, n)
    if not size:
        return hashes
    count = n - size + 1
    out = hashes[:count] + np.uint64(size)
    for k in range(1, size):
        out = ((out ^ (out >> _HALF)) * _MULTIPLY) + hashes[k:k + count]
    out = (out ^ (out >> _HALF)) * _MIX
    return out ^ (out >> _HALF)


def distinct_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The set of run hashes, in ascending order."""
    return np.unique(run_hashes(hashes, size))
