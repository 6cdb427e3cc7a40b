"""Word shingles as 64-bit hashes.

Words are runs of characters other than blank and U+0009..U+000D, after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Remembered word hashes a worker.
REMEMBERED = 150_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_words = _Words()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter((_words[w] for w in words), np.uint64, len(words))
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            h = h * _BASE + hashes[i : len(words) - k + 1 + i]
        return np.unique(_finish(h))
