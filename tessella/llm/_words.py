"""Words and window hashes of one text, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters in lower case, other ASCII signs as blanks.
PLAIN = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their order."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row; a power of two of them by doubling, else word by word."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h, size = words, 1
    while size * 2 <= n:
        h = mix(h[:-size] * _M + h[size:])
        size *= 2
    if size < n:
        rest = window_hashes(words, n - size)
        h = mix(h[: len(words) - n + 1] * _M + rest[size:])
    return h
