"""Words of whole texts as arrays: spans and 64-bit hashes, straight from Arrow's UTF-8 buffers.

A word is a run of bytes outside a set of ASCII separators. As separators are single ASCII bytes, runs of bytes
are runs of characters, and no text has to be decoded. A null text has no words. Chunks keep memory bounded:
each holds whole texts of about ``CHUNK`` bytes together, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word characters are digits, lower-case letters and everything beyond ASCII.
_NOT_ITEM = np.ones(256, bool)
_NOT_ITEM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_POWERS = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        grown = np.empty(size, _U)
        grown[0] = 1
        grown[1:] = _U(_BASE)
        _POWERS = np.cumprod(grown, dtype=_U)
    return _POWERS


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i+1]`` are those of text ``i`` of the chunk."""

    data: np.ndarray  # bytes, lower-cased if asked for
    base: np.ndarray  # where each text starts in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    row: int  # of the chunk's first text in the batch

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(self.texts), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each position on, and whether they lie in one text."""
        return grams(self.hash, self.first, n)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(hashes)
    total = hashes.copy()
    for j in range(1, n):
        total[:max(size - j, 0)] += hashes[j:] * _U(pow(_STEP, j, 1 << 64))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(size)
    return mix(total + _U(n)), left >= n


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.empty(0, _U)
    size = end - start
    powers = _powers(int(size.max()))
    offset = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(offset, size)
    return mix(np.add.reduceat(_BYTE[data[within + np.repeat(start, size)]] * powers[within], offset)
               + size.astype(_U) * _U(_STEP))


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, min(to, n)
        at = to


def words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, items: bool = False) -> Iterator[Words]:
    """Chunks of words of a column of texts. ``items``: separators are all ASCII but digits and letters."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    fold, gap = (_LOWER if lower or items else _SAME), (_NOT_ITEM if items else _SPACE)
    for a, b in _chunks(offsets):
        data = fold[body[offsets[a]:offsets[b]]]
        base = offsets[a:b] - offsets[a]
        inside = ~gap[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        own = base[base < len(data)]
        begins[own] = inside[own]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        last = own[own > 0] - 1
        ends[last] = inside[last]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, np.append(base, len(data)))
        yield Words(data, base, start, end, first, hash_words(data, start, end), a)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the words of each text."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
