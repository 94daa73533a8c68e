"""Byte-level word splitting that follows the contracts exactly and runs at C speed."""

from __future__ import annotations

import numpy as np

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
#: Keeps 0-9, a-z and bytes of non-ASCII characters, lowers A-Z, turns all else into spaces.
ALNUM = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
LOWER = bytes.maketrans(_UPPER, _LOWER)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (bytes.split knows just these six white spaces)."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(ALNUM).split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash (xxh3), remembered for up to ``bound`` words."""

    def __init__(self, bound: int = 600_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; with fewer words (but some) the whole sequence as one."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(width, n)
    h = np.full(n - k + 1, 0x9E3779B97F4A7C15 + k if k < width else 0x9E3779B97F4A7C15, dtype=np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x100000001B3) + word_hashes[j : n - k + 1 + j])
    return h
