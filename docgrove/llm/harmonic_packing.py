"""Packing token sequences by harmonic classes.

Class k takes pieces longer than capacity / (k + 1) and at most capacity / k; a bin of class k is full with exactly k of
them. A bin depends on nothing but the pieces of its class, so each worker fills its own bins in one pass over its
documents, without a shuffle, and holds only bins not yet full: at most k - 1 pieces of each class.

A bin of class k wastes what its pieces fall short of capacity / k. A document is therefore cut where that would be
much: into full sequences first, then, while more than `small` ids are left and the class would waste more than
`waste`, at the largest capacity / (k + 1) below. Pieces of at most `small` ids stay whole, since their classes are dense.
Bins not full when a worker ends (a fixed number at most) are emptied and packed first-fit by falling length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docgrove.llm.tables import narrow
from docgrove.llm.words import release, text_column

CAPACITY, SMALL, WASTE = 1024, 64, 0.03
VOCABULARY = "byte_bpe_50k"
#: Characters on which both tokenizer libraries' patterns surely agree: no controls, and no marks or scripts whose
#: class has changed between Unicode versions. Texts with others, or with a special token's string, go the exact way.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ʬ]*")
_SPECIAL = "<|endoftext|>"
#: Worker, then the worker's own number, in one sequence id.
_WORKER_BITS = 36


@lru_cache(1)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _fast(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, json_path: str, ranks_path: str | None) -> list[int]:
    """The ids of `tokenizers` for the vocabulary at json_path. Where the same vocabulary is given as ranks, plain texts
    are encoded by the quicker library, which gives the same ids."""
    if ranks_path and _PLAIN.fullmatch(text) and _SPECIAL not in text:
        return _fast(ranks_path).encode_ordinary(text)
    return _exact(json_path).encode(text, add_special_tokens=False).ids


@lru_cache(None)
def _tail(rest: int, capacity: int, small: int, waste: float) -> tuple[int, ...]:
    lengths = []
    while rest:
        k = capacity // rest
        if rest <= small or capacity - k * rest <= waste * capacity:
            lengths.append(rest)
            break
        lengths.append(capacity // (k + 1))
        rest -= lengths[-1]
    return tuple(lengths)


def cut(length: int, capacity: int = CAPACITY, small: int = SMALL, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces of a document of `length` ids, in order."""
    return [capacity] * (length // capacity) + list(_tail(length % capacity, capacity, small, waste))


class Bins:
    """One worker's open bins. A piece is (row..., length); full bins come out of `add`, the rest out of `close`."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.made = capacity, {}, 0

    def _number(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for piece in pieces:
            out.append((*piece, self.made, offset))
            offset += piece[-1]
        self.made += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[-1]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self._number(self.open.pop(k)) if len(held) == k else []

    def close(self) -> list[tuple]:
        rest = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[-1])
        bins: list[list[tuple]] = []
        room: list[int] = []
        for piece in rest:
            at = next((i for i, r in enumerate(room) if r >= piece[-1]), None)
            if at is None:
                at = len(bins)
                bins.append([])
                room.append(self.capacity)
            bins[at].append(piece)
            room[at] -= piece[-1]
        self.open = {}
        return [row for held in bins for row in self._number(held)]


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, small: int = SMALL,
         waste: float = WASTE, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and id 0, so an empty one is a piece of one id. Rows without an
    id and repeated rows are packed like any other. Other columns of `docs` are not read. The result follows from the
    order in which the table is read; a task that is run again gives the same rows.
    """
    if json_path is None:
        json_path, ranks_path = public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken")

    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _WORKER_BITS
        bins = Bins(capacity)

        def batch(rows):
            doc, start, crc, tokens, length, number, offset = zip(*rows) if rows else ([],) * 7
            columns = [doc, start, length, crc, tokens, [base + n for n in number], offset]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

        for table in batches:
            rows: list[tuple] = []
            for doc, words in zip(table.column(0).to_pylist(), text_column(table.column(1))):
                ids = np.array([*encode(words.as_py(), json_path, ranks_path), 0], "<u4")
                start = 0
                for length in cut(len(ids), capacity, small, waste):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    rows += bins.add((doc, start, crc, len(ids), length))
                    start += length
            yield batch(rows)
            rows = []
            del table
        yield batch(bins.close())
        # The vocabularies take more room in a worker than time to load.
        _fast.cache_clear()
        _exact.cache_clear()
        release()

    return narrow(docs, id_column, text).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))
