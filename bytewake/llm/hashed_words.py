"""Words of a text column as 64-bit hashes, in numpy.

A word is a run of bytes that are not separators; separators are ASCII, so a
word of UTF-8 bytes is a word of code points.  A-Z hash as a-z.  The hash is a
polynomial over a fixed random table, mixed; two of n different words share one
with a chance of about n * n / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes that are looked at together
WINDOW = 1 << 20
_RANDOM = np.random.default_rng(20240501)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes separate words."""
    found = np.zeros(256, bool)
    for first, last in ranges:
        found[first:last + 1] = True
    return found


BLANK = separators((0x20, 0x20), (0x09, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each text begins and the last ends; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def _windows(data: np.ndarray, apart: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(data):
        end = min(start + WINDOW, len(data))
        while end < len(data):  # on to the next separator
            found = np.flatnonzero(apart[data[end:end + WINDOW]])
            if len(found):
                end += int(found[0])
                break
            end = min(end + WINDOW, len(data))
        yield start, end
        start = end


def words(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, in order; no word reaches over one of the bounds."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    found = [_words(data[a:b], cut[a:b], apart, a) for a, b in _windows(data, apart)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _words(data, cut, apart, base):
    inside = ~apart[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    parts = _VALUES[data[at]] * powers[np.arange(len(at)) - np.repeat(begin, lengths)]
    hashed = mix(np.add.reduceat(parts, begin) + lengths.astype(np.uint64))
    return starts + base, starts + lengths + base, hashed


def per_text(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of each text begin among all words, and where the last end."""
    return np.searchsorted(starts, bounds)
