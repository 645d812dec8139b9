"""Helpers of the text operators: Arrow text columns as numpy words, with hashes of words and word n-grams.

A word is a run of bytes outside 0x09-0x0D and 0x20. All of these are ASCII, so words of the UTF-8 bytes are the
words of the text. Hashes are polynomial sums modulo 2^64 with an odd base, finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Half a megabyte of text at a time: the arrays beside it take about 30 times as much.
SLICE_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that ends a word, and line ends.
WHITE = " \t\n\x0b\x0c\r"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        have = _powers[base] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """The words of some texts: where each starts and ends in ``data``; ``first[d]:first[d+1]`` are those of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of two independent 64-bit hashes of each word."""
        power, inverse = _power_tables(_BASES[which], len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one longer row."""
    ends = bounds(texts)[1]
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column without nulls (null: empty), with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column from :func:`as_texts`, and where its texts begin and end in them."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of a column from :func:`as_texts`; with ``lower``, A-Z are lower-cased first."""
    data, ends = bounds(texts)
    n = len(texts)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, np.uint8), empty, empty, np.zeros(1, dtype=np.int64))
    base = int(ends[0])
    data, ends = data[base:int(ends[-1])], ends - base
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    # Texts are adjacent: a word that begins a text starts even where the one before ended in a word.
    begins = inside[1:] & ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    begins[cuts] |= inside[cuts + 1]
    start = np.flatnonzero(begins)
    stops = inside[:-1] & ~inside[1:]
    cuts = ends[1:][ends[1:] > 0]
    stops[cuts] |= inside[cuts]
    end = np.flatnonzero(stops)
    return Words(data, start, end, np.searchsorted(start, ends))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all word n-grams inside one text, and the index of each one's first word."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = np.uint64(_BASES[1 - which] | 1)
    out = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        out *= base
        out += hashes[k:k + total]
    lengths = np.diff(first)
    left = np.repeat(first[1:], lengths)[:total] - np.arange(total)
    at = np.flatnonzero(left >= n)
    return mix(out[at]), at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if len(keys) == 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
