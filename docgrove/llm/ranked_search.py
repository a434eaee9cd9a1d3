"""The best documents for each of many texts, ranked by shared terms, with bounds from hashed max-sketches.

Items (the texts to search for) are taken in blocks of bounded size, whose terms and weights every task holds. For each block
all documents are read twice, where they lie and without a shuffle of texts: for the statistics, and for the ranking:

1. The impact of a term in a document is what its score gains by it, before the term's weight. A document's impacts fold into
   a sketch: each term has a hashed coordinate, and a coordinate holds the largest impact that falls on it.
2. The sketches of a slice of documents, as a matrix, times the items' weights summed by coordinate give upper bounds for all
   items at once: a coordinate's maximum is no less than the impact of any term on it.
3. For each item the documents of a slice are scored exactly in the order of falling bounds, until the next bound is
   below the worst of the best so far. Bounds that equal it are scored too, so ties are decided by exact scores and ids.

A task ends with at most `top` documents for each item; these are ranked within groups of tasks first, then together.

Null texts have no terms. An item without terms, or none of whose terms occur, has no rows; items repeat if their rows do. Every row
of `docs` is a document, repeated rows too; among equal scores the lesser id goes first, no id last. Texts are taken whole;
one of any length is a slice of its own. An empty table of either kind gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrove.llm.tables import keep, narrow
from docgrove.llm.terms import term_codes, text_terms
from docgrove.llm.words import mix, text_column

TOP = 10
#: Bytes of text and number of the items of a block: what a task holds of them. One longer item is a block of its own.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096
#: Coordinates of a sketch, bytes of documents sketched and multiplied at once, and documents scored at once at first.
COORDINATES, SLICE_BYTES, FIRST = 1024, 1 << 21, 16
#: Groups of tasks whose best are ranked first.
TASK_GROUPS = 64


@dataclass
class Block:
    """Items as arrays: `terms` are the distinct terms of all, sorted; of each item its terms' numbers and repeats."""

    ids: list[int | None]
    terms: pa.Array
    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None


def make_block(ids: list[int | None], texts: list[str | None]) -> Block:
    """Of each item its terms and how often each occurs in it."""
    rows = []
    for _, counts, codes, distinct in term_codes(text_column(pa.array(texts, pa.string())), True, SLICE_BYTES):
        names, at = distinct.cast(pa.binary()).to_pylist(), 0
        for n in counts.tolist():
            rows.append([names[c] for c in codes[at : at + n].tolist()])
            at += n
    number = {t: i for i, t in enumerate(sorted({t for row in rows for t in row}))}
    items = [np.unique(np.array([number[t] for t in row], np.int64), return_counts=True) for row in rows]
    return Block(ids, pa.array(list(number), pa.large_binary()), items)


def _known(texts: pa.Array, terms: pa.Array):
    """For slices of texts: first row, number of all terms of each text, and (text, number of the term, occurrences) of
    those that are among `terms`."""
    for row, counts, codes, distinct in term_codes(texts, True, SLICE_BYTES):
        number = pc.index_in(distinct, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at, code, tf = text_terms(counts, codes, len(distinct))
        term = number[code]
        found = term >= 0
        at, term, tf = at[found], term[found], tf[found]
        order = np.argsort(at * (len(terms) + 1) + term)
        yield row, counts, at[order], term[order], tf[order]


def statistics(docs: DataFrame, block: Block, text: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms with repeats in all of them, and for each term of the block the documents with it."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        terms = sent.value.terms
        having, total, df = 0, 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, counts, _, term, _ in _known(text_column(batch.column(0)), terms):
                having, total = having + int(np.count_nonzero(counts)), total + int(counts.sum())
                df += np.bincount(term, minlength=len(terms))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, there]), pa.array(np.r_[having, total, df[there]])], ["term", "n"])

    rows = docs.select(f"`{text}`").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # one row for each term of the block at most
    got = dict(zip(found["term"].to_pylist(), found["n"].to_pylist()))
    df = np.array([got.get(i, 0) for i in range(len(block.terms))], np.int64)
    return got.get(-1, 0), got.get(-2, 0), df


def term_weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What occurrences of a term add to a document's score, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * length * documents) // total))


class _Best:
    """The best documents of one item so far: score falling, then id rising, no id last."""

    def __init__(self, top: int):
        self.top, self.score, self.none, self.id = top, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        score, none, ids = np.r_[self.score, score], np.r_[self.none, none], np.r_[self.id, ids]
        order = np.lexsort((ids, none, -score))[: self.top]
        order = order[score[order] > 0]
        self.score, self.none, self.id = score[order], none[order], ids[order]


def _rank(batches, block: Block, documents: int, total: int, top: int):
    terms, items = len(block.terms), block.items
    spot = (mix(np.arange(1, terms + 1, dtype=np.uint64)) % np.uint64(COORDINATES)).astype(np.int64)
    lookups = np.zeros((COORDINATES, len(items)))
    for i, (own, times) in enumerate(items):
        np.add.at(lookups[:, i], spot[own], block.weights[own] * times)
    gains = [block.weights[own] * times for own, times in items]
    best = [_Best(top) for _ in items]
    for batch in batches:
        column = batch.column(0)
        none, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
        for row, counts, at, term, tf in _known(text_column(batch.column(1)), block.terms):
            if not len(at):
                continue
            impact = impacts(tf, counts[at], documents, total)
            fold = at * COORDINATES + spot[term]
            order = np.argsort(fold, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(fold[order]) > 0])
            sketches = np.zeros(len(counts) * COORDINATES)
            sketches[fold[order][begins]] = np.maximum.reduceat(impact[order], begins)
            bounds = (sketches.reshape(len(counts), COORDINATES) @ lookups) * (1 + 1e-9)  # beyond 2**53 sums are rounded
            keys = at * terms + term
            least = np.array([b.least() for b in best])
            for i in np.flatnonzero((bounds >= least).any(axis=0)).tolist():
                own, bound = items[i][0], bounds[:, i]
                left = np.flatnonzero(bound >= least[i])
                left = left[np.argsort(-bound[left], kind="stable")]
                done, size = 0, FIRST
                while done < len(left) and bound[left[done]] >= best[i].least():
                    some = left[done : done + size]
                    wanted = some[:, None] * terms + own[None, :]
                    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    score = np.where(keys[place] == wanted, impact[place], 0) @ gains[i]
                    best[i].add(score, none[row + some], ids[row + some])
                    done, size = done + size, size * 2
    for i in range(0, len(best), 256):
        part = best[i : i + 256]
        number = np.repeat(np.arange(i, i + len(part)), [len(b.score) for b in part])
        empty = np.concatenate([b.none for b in part])
        columns = [
            pa.array(number), pa.array(np.concatenate([b.id for b in part]), mask=empty), pa.array(np.concatenate([b.score for b in part])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["number", "doc_id", "score"])


def _first(rows: DataFrame, top: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_block(docs: DataFrame, block: Block, top: int = TOP) -> DataFrame | None:
    """(item_id, rank, doc_id, score) for the items of one block; docs: doc_id and text. None if no document has a term."""
    documents, total, df = statistics(docs, block)
    if not documents:
        return None
    block.weights = term_weights(documents, df)
    sent = docs.sparkSession.sparkContext.broadcast(block)
    found = docs.mapInArrow(lambda batches: _rank(batches, sent.value, documents, total, top), "number long, doc_id long, score long")
    found = _first(found.withColumn("tasks", F.spark_partition_id() % TASK_GROUPS), top, "number", "tasks").drop("rank")
    ranked = _first(found, top, "number")
    names = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "number long, item_id long")
    return ranked.join(names, "number").select("item_id", "rank", "doc_id", "score")


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text"):
    """The items in blocks of bounded size, dealt by a hash of their text and id; read block by block."""
    sized = narrow(items, item_id, text).withColumnsRenamed({item_id: "item_id", text: "text"})
    size = sized.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))), F.count(F.lit(1))).first()
    blocks = max((size[0] or 0) // BLOCK_BYTES, size[1] // BLOCK_ITEMS) + 1
    for i in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = part.orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield make_block(rows["item_id"].to_pylist(), rows["text"].to_pylist())


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (item_id, rank, doc_id, score) for each of an item's `top` best documents with a score above 0."""
    spark = docs.sparkSession
    plain = narrow(docs, id_column, text).withColumnsRenamed({id_column: "doc_id", text: "text"})
    found = None
    for block in item_blocks(items, item_id, item_text):
        part = search_block(plain, block, top)
        if part is not None:
            part = keep(part, "ranked")
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
