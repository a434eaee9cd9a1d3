"""Terms of whole Arrow columns of text: maximal runs of letters (and digits, where wanted), A-Z lower-cased, without a Python
object per term. Every code point from U+0080 on counts as a letter, so runs can be found in the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docgrove.llm.words import slices


def term_codes(texts: pa.Array, digits: bool, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For slices of `texts` of about `size` bytes: first row, number of terms of each text, the code of each term in
    the order of the text, and the distinct terms (binary) the codes stand for."""
    for row, data, offsets in slices(texts, size):
        low = data | np.uint8(32)
        inside = (data >= 128) | ((low >= 97) & (low <= 122))
        if digits:
            inside |= (data >= 48) & (data <= 57)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        opens[inner] |= inside[inner]
        closes[inner - 1] |= inside[inner - 1]
        starts = np.flatnonzero(opens)
        lengths = np.flatnonzero(closes) + 1 - starts
        letters = data[inside]
        letters = letters + np.uint8(32) * ((letters >= 65) & (letters <= 90))
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = runs.dictionary_encode()
        counts = np.diff(np.searchsorted(starts, offsets))
        yield row, counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def text_terms(counts: np.ndarray, codes: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, occurrences) of every distinct term of every text, in this order."""
    pairs = np.repeat(np.arange(len(counts)), counts) * max(distinct, 1) + codes
    pairs, times = np.unique(pairs, return_counts=True)
    return pairs // max(distinct, 1), pairs % max(distinct, 1), times.astype(np.int64)
