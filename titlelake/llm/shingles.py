"""Hashed word shingles: words are runs of bytes other than ASCII white space, with A-Z in lower case."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered for each worker; beyond it the memory starts afresh.
CACHE_WORDS = 250_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> _SHIFT)) * _MIX[0]
    h = (h ^ (h >> _SHIFT)) * _MIX[1]
    return h ^ (h >> _SHIFT)


def words(text: str) -> list[bytes]:
    """bytes.split cuts at exactly 0x20 and 0x09-0x0D; bytes.lower changes exactly A-Z."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct hashes (ascending) of the ``size``-word shingles; a shorter
    text is one shingle of all its words; a text without words has none."""
    own = words(text)
    if not own:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, own), dtype=np.uint64, count=len(own))
    k = min(size, len(w))
    h = w[: len(w) - k + 1].copy()
    for i in range(1, k):
        h *= _MULT
        h += w[i : len(w) - k + 1 + i]
    return np.unique(mix(h + np.uint64(k)))
