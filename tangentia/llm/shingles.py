"""Word and shingle kernels shared by the operators that work on word sequences.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``.  ``bytes.split()``
cuts at exactly these six ASCII bytes and ``bytes.lower()`` lower-cases only
``A-Z``, so working on UTF-8 bytes gives the documented semantics without a
regular expression.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries after which a per-process word cache is emptied (bounds memory).
WORD_CACHE_LIMIT = 150_000

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93],
    dtype=np.uint64,
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text; null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit word hashes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles.

    A sequence shorter than ``width`` is one shingle as a whole; an empty one
    has no shingle.
    """
    n = len(hashes)
    if n == 0:
        return hashes
    with np.errstate(over="ignore"):
        w = min(width, n)
        acc = np.full(n - w + 1, np.uint64(n if n < width else 0), dtype=np.uint64)
        for k in range(w):
            acc = acc * np.uint64(0x100000001B3) + hashes[k : n - w + 1 + k] * _MULTIPLIERS[k % 5]
        return np.unique(mix(acc))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0, len(b)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    inter = int(np.count_nonzero(b[at] == a))
    return inter, len(a) + len(b) - inter
