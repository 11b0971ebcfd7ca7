"""Words, word shingles and hashed features of whole texts, as numpy arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Odd multipliers of a 64-bit mixing step.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)

#: Words whose hash a worker keeps: some 15 MB. A full cache starts afresh, which costs a hash for each word in use.
CACHE_WORDS = 100_000
_hashes: dict[bytes, int] = {}


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, which is just this.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once a worker."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    try:
        return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    except KeyError:
        for w in ws:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words in order; a shorter text is one run, no words give none."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * _STEP + h[j : j + n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(words(text)), k))


def digest(a: np.ndarray) -> bytes:
    return hashlib.blake2b(a.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


