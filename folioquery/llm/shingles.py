"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix64

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.multiply.accumulate(np.full(WORDS, 0xD6E8FEB86659FD93, np.uint64))
_powers = np.multiply.accumulate(np.full(64, _BASE))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each maximal run of bytes other than space and 0x09 to 0x0D, A to Z in lower case."""
    global _powers
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    if size.max() > len(_powers):
        _powers = np.multiply.accumulate(np.full(2 * int(size.max()), _BASE))
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    value = (raw[inside].astype(np.uint64) + np.uint64(1)) * _powers[place]
    return mix64(np.add.reduceat(value, begin) + size.astype(np.uint64))


def shingle_set(text: str) -> np.ndarray:
    """Distinct shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    size = min(WORDS, len(words))
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _FACTORS[i]
    return np.unique(mix64(total))


def signature(values: np.ndarray) -> tuple[int, int]:
    """Two sums that equal sets share, as signed 64-bit numbers."""
    return tuple(int(mix64(values ^ np.uint64(salt)).sum().astype(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
