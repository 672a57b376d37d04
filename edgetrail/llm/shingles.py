"""Words and hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 250_000  # about 45 MB in a Python worker
CACHED_BYTES = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# ASCII bytes that are neither letters, digits nor the underscore part words; every other byte belongs to one.
_PARTING = bytes(32 if b < 128 and not (chr(b).isalnum() or b == 95) else b for b in range(256))


def spaced_words(text: str) -> list[bytes]:
    """Words between white space, with A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def plain_words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8").translate(_PARTING).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            self[word] = h
        return h


_hashes = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    _hashes.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, in order; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for i in range(size):
        out = out * _MULTIPLIER + words[i : i + n]
    return mixed(out)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles; a shorter text is one shingle of all its words."""
    return np.unique(shingles(words, min(size, len(words)) or size))
