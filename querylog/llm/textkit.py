"""Word and shingle hashing with numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LOWERED = bytes(range(256)).lower()
#: Lower-cases A to Z and turns all but digits, letters and non-ASCII bytes into spaces.
PLAIN_TABLE = bytes(b if b in _KEPT else 0x20 for b in _LOWERED)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return text.translate(PLAIN_TABLE).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; empty for shorter texts."""
    count = len(hashes) - size + 1
    if count <= 0:
        return hashes[:0]
    out = hashes[:count] + np.uint64(size)
    for i in range(1, size):
        out = mixed(out) + hashes[i : i + count]
    return mixed(out)


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; shorter texts are one shingle, empty ones none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolled(word_hashes(words), min(size, len(words))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
