"""Words and word shingles of whole texts as 64-bit digests, computed on whole column buffers.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. UTF-8 keeps those
separators out of longer characters, so bytes are enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20  # texts are worked on in slices of about this size, so memory follows one text at most

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = _U(0x9E3779B97F4A7C15)
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), _BASE, dtype=np.uint64))


def text_slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a string column; a null text counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and per row the number of words before it (rows + 1 values)."""
    inside = _IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digest of every word, and per row the number of words before it."""
    starts, ends, before = word_bounds(data, offsets)
    return digests_of(data, starts, ends), before


def digests_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A digest of the lower-cased bytes of every word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = _LOWER[data[place + np.repeat(starts, lengths)]].astype(np.uint64) + _U(1)
    values *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, firsts))


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct digests of the shingles of `size` words, five at most) of every text.

    Fewer words than a shingle make one shingle of the whole sequence; no words make an empty set.
    """
    for first, data, offsets in text_slices(column):
        words, before = word_digests(data, offsets)
        runs = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
        for i in range(size):
            runs += words[i : i + len(runs)] * _PLACES[i]
        runs = mix(runs)
        for row in range(len(offsets) - 1):
            a, b = int(before[row]), int(before[row + 1])
            if b - a >= size:
                yield first + row, np.unique(runs[a : b - size + 1])
            elif b > a:
                short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + _U(b - a)
                yield first + row, mix(np.array([short], dtype=np.uint64))
            else:
                yield first + row, np.zeros(0, np.uint64)
