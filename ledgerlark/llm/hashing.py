"""Hashes of words and of word windows, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

# Bytes of a text that are hashed at once, if there is a blank to cut at.
AT_ONCE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
# Base of the polynomials, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C17
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = (values ^ (values >> _SHIFT)) * _MIX
    return values ^ (values >> _SHIFT)


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each window of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, np.uint64(seed), dtype=np.uint64)
    for i in range(width):
        total = total * _FACTOR + hashes[i : i + n]
    return mixed(total)


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each row of a string column without nulls."""
    if not len(column):
        return iter(())
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return (data[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


class WordHasher:
    """64-bit hashes of the words of a text, for all of them at once.

    Words are what the blanks ``[\\x20\\x09-\\x0D]`` leave. The bytes, each as a 64-bit
    number, are the coefficients of one polynomial; a word's hash is the part of its
    prefix sums between the word's ends, shifted back to its start.
    """

    def __init__(self, lower: bool = False):
        """``lower``: A-Z hash like a-z."""
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
        if lower:
            self.values[65:91] = self.values[97:123]
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            powers = np.full(n, np.uint64(base), dtype=np.uint64)
            powers[:1] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def words(self, data: np.ndarray) -> np.ndarray:
        parts = []
        while len(data) > AT_ONCE:
            blanks = np.flatnonzero(_BLANK[data[AT_ONCE : 2 * AT_ONCE]])
            if not len(blanks):
                break
            parts.append(self._words(data[: AT_ONCE + blanks[0]]))
            data = data[AT_ONCE + blanks[0] :]
        parts.append(self._words(data))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _words(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self._grow(max(n, 1 << 16))
        inside = np.zeros(n + 2, dtype=np.int8)
        inside[1:-1] = ~_BLANK[data]
        ends = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = ends[0::2], ends[1::2]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        return mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64) * _FACTOR)
