"""Word and shingle hashing in numpy, shared by the Python-side operators.

``bytes.lower`` and ``bytes.split`` follow exactly the ASCII rules of
:mod:`.common` (lower-case A-Z; separators ``[\\x20\\x09-\\x0D]``).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(31), np.uint64(27)


def give_back() -> None:
    """Return freed memory to the system (the allocators of numpy and Arrow keep it otherwise)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back when its task ends; idle Python workers then hold little."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgotten when too many have been seen."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    w = split_words(text)
    return np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S1)) * _P2
    return h ^ (h >> _S2)


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; all words as one shingle where there are fewer than k."""
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = mix(w[:n] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * _P1 + w[j : j + n])
    return np.unique(h)


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
