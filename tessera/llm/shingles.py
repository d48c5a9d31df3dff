"""Word shingles as sorted sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a worker keeps; bounds its memory.
MEMO_WORDS = 400_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that their bits can serve as order and as bucket numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of k-word shingles; a shorter text's words are one shingle, a text without words has the empty set."""

    def __init__(self, k: int):
        self.k, self.memo = k, _Memo()

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * _MUL + w[j : j + n]
        return np.unique(mix(h))


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], np.uint64).view(np.int64)[0])
