"""Word and shingle hashes of whole Arrow columns of text, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A column is taken in slices of
about half a megabyte, so memory does not grow with the batch; one text longer than that is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """`column` as one large_string array, null as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def release() -> None:
    """Give back to the system what is free: a worker stays for later tasks, and would hold it beside whatever they need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of consecutive rows with about `size` bytes of text."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    opens[inner] |= inside[inner]
    closes[inner - 1] |= inside[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    powers = np.full(int(lengths.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    first = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    place = np.arange(len(first)) + first
    letters = data[place]
    letters = letters + np.uint8(32) * ((letters >= 65) & (letters <= 90))
    begins = np.cumsum(lengths) - lengths
    values = (letters.astype(np.uint64) + np.uint64(1)) * powers[place - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64) * _FACTOR)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and the text of each; a shorter text is one run of all its words."""
    counts = np.diff(firsts)
    full = max(len(hashes) - width + 1, 0)
    runs = np.full(full, np.uint64(width))
    for i in range(width):
        runs *= _FACTOR
        runs += hashes[i : i + full]
    runs = mix(runs)
    has = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), has)
    runs = runs[np.arange(len(owner)) + np.repeat(firsts[:-1] - np.cumsum(has) + has, has)]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        value = counts[short].astype(np.uint64)
        for i in range(width - 1):
            has = counts[short] > i
            value[has] = value[has] * _FACTOR + hashes[firsts[:-1][short][has] + i]
        runs, owner = np.concatenate([runs, mix(value)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        runs, owner = runs[order], owner[order]
    return runs, owner


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of `texts`: first row, distinct shingles sorted within each text, and the bounds of each text's."""
    for row, data, offsets in slices(texts):
        starts, ends, firsts = word_bounds(data, offsets)
        runs, owner = shingles(word_hashes(data, starts, ends), firsts, width)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            runs[a:b].sort()
        fresh = np.ones(len(runs), bool)
        fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
        yield row, runs[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]
