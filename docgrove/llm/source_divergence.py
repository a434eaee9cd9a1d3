"""How the words of each source differ from those of the other sources of its language, by an inverted index built in one pass.

1. Blocks: a task reads its documents once and gathers postings (language, term, source, occurrences, documents) in memory.
   When they fill BLOCK_BYTES, equal ones are added up; if that does not help, the block is spilled as a run, sorted by
   term, in chunks for each hash shard of (language, term). A term that stands in every document is one posting of a run.
2. Runs: a shard gets the chunks of all runs ordered by their first term and merges them: open chunks lie on a heap by
   their last term, and what lies before the first term of the next chunk is complete. Memory holds the open chunks, not
   the shard. The merge leaves the kept terms, those in at least `least_docs` documents of their language.
3. Pairs: a slice of a language's kept terms meets the totals of its sources. Most (term, source) cells are empty, and an empty
   cell's share depends on the source alone; so the sum over all terms is that of empty cells, plus a correction for each cell
   that one source has, plus one for each cell that both have, streamed over the postings. Slices are bounded in postings.

All arithmetic is in whole numbers. Null language, source or text is the empty string. Every row is a document, repeated
rows too. An empty table, or one whose texts have no terms, has no rows of terms; pairs of sources without kept terms have 0.
Texts are taken whole; one of any length is a slice of its own. Ties go by the bytes of the item. Columns other than the three are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrove.llm.tables import keep, shuffle_partitions
from docgrove.llm.terms import term_codes, text_terms
from docgrove.llm.words import text_column, word_hashes

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Memory of a block before it is spilled, bytes of text taken at once, postings of a chunk and of a merge step.
BLOCK_BYTES, SLICE_BYTES, CHUNK, MERGE = 24 << 20, 1 << 20, 1 << 13, 1 << 18
#: Postings of a slice of kept terms, and (posting, posting) corrections taken at once.
SLICE_POSTINGS, PAIRS = 1 << 18, 1 << 20

_POSTING = {"group": pa.int32(), "term": pa.large_binary(), "tf": pa.int64(), "df": pa.int64()}
_CHUNK = "shard int, lang string, first binary, last binary, terms array<binary>, sources array<string>, tf array<long>, df array<long>"


def _summed(parts: list[pa.Table], keys: list[str]) -> pa.Table:
    """`parts` with tf and df added up over equal keys."""
    added = pa.concat_tables(parts).combine_chunks().group_by(keys, use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
    return added.rename_columns([c.removesuffix("_sum") for c in added.column_names])


def _lists(values: pa.Array | pa.ChunkedArray, bounds: np.ndarray) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


class _Block:
    """Postings of the documents a task has read since its last spill."""

    def __init__(self, shards: int):
        self.shards, self.groups, self.parts, self.bytes = shards, {}, [], 0

    def add(self, names: list[tuple[str, str]], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        numbers = np.array([self.groups.setdefault(n, len(self.groups)) for n in names], np.int64)
        for row, counts, codes, distinct in term_codes(texts, False, SLICE_BYTES):
            at, code, tf = text_terms(counts, codes, len(distinct))
            if not len(at):
                continue
            key = numbers[row + at] * len(distinct) + code
            order = np.argsort(key, kind="stable")
            key = key[order]
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            columns = [
                pa.array((key[begins] // len(distinct)).astype(np.int32)), distinct.take(pa.array(key[begins] % len(distinct))),
                pa.array(np.add.reduceat(tf[order], begins)), pa.array(np.diff(np.r_[begins, len(key)])),
            ]
            self.parts.append(pa.table(columns, names=list(_POSTING)))
            self.bytes += self.parts[-1].nbytes
            if self.bytes > BLOCK_BYTES:
                self.parts = [_summed(self.parts, ["group", "term"]).select(list(_POSTING))]
                self.bytes = self.parts[0].nbytes
                if self.bytes > BLOCK_BYTES // 2:
                    yield from self.spill()
                    numbers = np.array([self.groups.setdefault(n, len(self.groups)) for n in names], np.int64)

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The block as one run: chunks by shard and language, each sorted by term and source."""
        if not self.parts:
            return
        names, run = list(self.groups), _summed(self.parts, ["group", "term"])
        order = np.argsort(np.array([repr(n) for n in names]))  # any fixed order will do for sources of one term
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        group = run["group"].to_numpy()
        langs = sorted({n[0] for n in names})
        lang = np.array([langs.index(n[0]) for n in names], np.int64)[group]
        term = run["term"].combine_chunks()
        bounds = np.frombuffer(term.buffers()[1], np.int64)[term.offset : term.offset + len(term) + 1]
        hashes = word_hashes(np.frombuffer(term.buffers()[2], np.uint8), bounds[:-1], bounds[1:])
        salt = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)[lang]
        shard = ((hashes ^ salt) % np.uint64(self.shards)).astype(np.int64)
        keyed = pa.table({"shard": shard, "lang": lang, "term": term, "place": place[group]})
        order = pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in keyed.column_names])
        run = run.take(order)
        at = (shard * len(langs) + lang)[order.to_numpy()]
        edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        edges = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(edges, edges[1:])] + [edges]))
        sources = pa.array([n[1] for n in names], pa.string()).take(run["group"].combine_chunks())
        terms = run["term"].combine_chunks().cast(pa.binary())
        columns = [
            pa.array((at[edges[:-1]] // len(langs)).astype(np.int32)),
            pa.array(langs, pa.string()).take(pa.array(at[edges[:-1]] % len(langs))),
            terms.take(pa.array(edges[:-1])), terms.take(pa.array(edges[1:] - 1)),
            *[_lists(x, edges) for x in (terms, sources, run["tf"], run["df"])],
        ]
        self.groups, self.parts, self.bytes = {}, [], 0
        pa.default_memory_pool().release_unused()
        run = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _CHUNK.split(", ")])
        for i in range(0, run.num_rows, 64):
            yield run.slice(i, 64)


def _runs(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        block = _Block(shards)
        for batch in batches:
            lang, source = (batch.column(i).fill_null("").to_pylist() for i in (0, 1))
            yield from block.add(list(zip(lang, source)), text_column(batch.column(2)))
        yield from block.spill()

    return docs.mapInArrow(run, _CHUNK)


def _kept(parts: list[pa.Table], lang: str, least_docs: int) -> pa.RecordBatch | None:
    """Complete postings of one language -> its kept terms among them, one row each."""
    every = _summed(parts, ["term", "source"]).sort_by([("term", "ascending"), ("source", "ascending")])
    term = every["term"].combine_chunks()
    fresh = np.r_[True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)] if len(term) else np.empty(0, bool)
    begins = np.flatnonzero(fresh)
    often = np.add.reduceat(every["df"].to_numpy(), begins) >= least_docs
    if not often.any():
        return None
    every = every.filter(pa.array(np.repeat(often, np.diff(np.r_[begins, len(term)]))))
    sizes = np.diff(np.r_[begins, len(term)])[often]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    columns = [
        pa.array([lang] * len(sizes), pa.string()), term.take(pa.array(begins[often])).cast(pa.string()),
        _lists(every["source"], bounds), _lists(every["tf"], bounds),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts"])


def _merged(runs: DataFrame, shards: int, least_docs: int) -> DataFrame:
    """(lang, term, sources, counts): the kept terms; sources and occurrences are arrays in step."""
    names = ["term", "source", "tf", "df"]

    def merge(batches):
        open_, pool, ready, lang, number = [], 0, 0, None, 0

        def cut(bound):
            """Take out all before `bound` (None: everything)."""
            nonlocal open_, pool
            pa.default_memory_pool().release_unused()
            done = []
            while open_ and (bound is None or open_[0][0] < bound):
                done.append(heapq.heappop(open_)[2])
            rest = []
            for last, n, part in open_:
                at = pc.sum(pc.less(part["term"], pa.scalar(bound, pa.binary()))).as_py() or 0
                if at:
                    done.append(part.slice(0, at))
                rest.append((last, n, part.slice(at)))
            open_ = rest
            heapq.heapify(open_)
            pool = sum(part.num_rows for _, _, part in open_)
            return _kept(done, lang, least_docs) if done else None

        for batch in batches:
            for i in range(batch.num_rows):
                first, last = batch["first"][i].as_py(), batch["last"][i].as_py()
                here = batch["lang"][i].as_py()
                if here != lang or pool > max(MERGE, 2 * ready):
                    found = cut(first if here == lang else None)
                    if found is not None:
                        yield found
                    lang, ready = here, pool
                part = pa.table([batch[c][i].values for c in ("terms", "sources", "tf", "df")], names=names)
                heapq.heappush(open_, (last, number, part))
                number, pool = number + 1, pool + part.num_rows
            # A copy of what is still open lets go of the batch it came in.
            open_ = [(last, n, part.take(pa.array(np.arange(part.num_rows)))) for last, n, part in open_]
        found = cut(None)
        if found is not None:
            yield found

    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("lang", "first")
    return dealt.mapInArrow(merge, "lang string, term string, sources array<string>, counts array<long>")


def _scaled(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + (SCALE * (counts + 2)) div (total + 2 * terms), by long division in base 1000: totals may reach 9e15."""
    below = np.maximum(np.asarray(total + 2 * terms, np.int64), 1)
    rest, found = np.asarray(counts, np.int64) + 2, np.zeros(np.broadcast(counts, below).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // below
        rest = rest % below
    return found + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    return key[begins], np.add.reduceat(value[order], begins)


def _slice_values(terms: pa.Table, totals: pa.Table, top: int) -> pa.Table:
    """What a slice of one language's kept terms adds to each pair of its sources, and each source's `top` own terms there."""
    totals = totals.sort_by("source").combine_chunks()
    source, n, v = totals["source"].combine_chunks(), totals["n"].to_numpy(), totals["v"].to_numpy()
    sources, lang_n = len(source), totals["lang_n"].to_numpy()[0]
    terms = terms.sort_by("term").combine_chunks()
    sizes = pc.list_value_length(terms["sources"]).to_numpy().astype(np.int64)
    term = np.repeat(np.arange(len(sizes)), sizes)
    group = pc.index_in(pc.list_flatten(terms["sources"]), value_set=source).to_numpy(zero_copy_only=False).astype(np.int64)
    count = pc.list_flatten(terms["counts"]).to_numpy()
    p, empty = _scaled(count, n[group], v[group]), _scaled(np.zeros(sources, np.int64), n, v)

    # Cells that only one source has: each distinct (source, count) against all others' empty cells.
    every = np.arange(sources)
    base = _apart(empty[:, None], empty[None, :]) * len(sizes)
    cells, times = np.unique(np.stack([group, count]), axis=1, return_counts=True)
    for at in range(0, len(times), max(1, PAIRS // sources)):
        part, many = cells[:, at : at + max(1, PAIRS // sources)], times[at : at + max(1, PAIRS // sources)]
        own = _scaled(part[1], n[part[0]], v[part[0]])
        extra = (_apart(own[:, None], empty[None, :]) - _apart(empty[part[0]][:, None], empty[None, :])) * many[:, None]
        np.add.at(base, part[0], extra)
        np.add.at(base.T, part[0], extra)  # the same pair, seen from the other source

    # Cells that both have: all pairs of postings of one term.
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(term)) - 1
    keys, values, at, ends = [], [], 0, np.cumsum(later)
    while at < len(term):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(at, end), later[at:end])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[at:end]) - later[at:end], later[at:end])
        g, h = group[a], group[b]
        extra = _apart(p[a], p[b]) - _apart(p[a], empty[h]) - _apart(empty[g], p[b]) + _apart(empty[g], empty[h])
        key, value = _sums([np.minimum(g, h) * sources + np.maximum(g, h)], [extra]) if len(a) else _sums([], [])
        keys.append(key)
        values.append(value)
        at = end
    key, value = _sums([k for k in keys if len(k)], [x for x in values if len(x)])
    base[key // sources, key % sources] += value
    base[key % sources, key // sources] += value
    g, h = np.nonzero(every[:, None] != every[None, :])

    # Terms a source has more of than its language.
    whole = np.bincount(term, weights=count, minlength=len(sizes)).astype(np.int64)
    q = _scaled(whole, lang_n, v[0])[term]
    value, more = _apart(p, q), p > q
    order = np.lexsort((term, -value, group))
    order = order[more[order]]
    first = np.searchsorted(group[order], every)
    best = order[np.arange(len(order)) - first[group[order]] < top]
    return pa.table({
        "source": source.take(pa.array(np.concatenate([g, group[best]]))),
        "part": pa.array(["pair"] * len(g) + ["term"] * len(best), pa.string()),
        "item": pa.chunked_array([source.take(pa.array(h)), terms["term"].combine_chunks().take(pa.array(term[best]))], pa.string()),
        "value": np.concatenate([base[g, h], value[best]]),
    })


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, sources, counts): the terms in at least `least_docs` documents of their language, with occurrences by source."""
    shards = shuffle_partitions(docs.sparkSession)
    plain = docs.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return _merged(_runs(plain, shards), shards, least_docs)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang: str = "lang", source: str = "source",
               text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source, part `pair` with every other source of its language, and
    part `term` with its `top` terms of the greatest share above the language's; see above."""
    terms = keep(kept_terms(docs, least_docs, lang, source, text), "kept_terms")
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    groups = docs.select(*named).distinct()
    postings = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "x.sources", "x.counts")
    own = postings.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.size("sources")).alias("postings"))
    langs = own.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(langs, "lang")
    totals = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    totals = keep(totals.withColumn("slices", F.expr(f"postings div {SLICE_POSTINGS} + 1")), "source_totals")

    parts = totals.select("lang", F.col("slices").alias("parts")).distinct()
    left = terms.join(parts, "lang").withColumn("part", F.pmod(F.xxhash64("term"), "parts"))
    right = totals.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    values = left.groupBy("lang", "part").cogroup(right.groupBy("lang", "slice")).applyInArrow(
        lambda key, a, b: _with_lang(key, _slice_values(a, b, top)),
        "lang string, source string, part string, item string, value long",
    )
    values = values.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def _with_lang(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
    return found.add_column(0, "lang", pa.repeat(key[0], found.num_rows))
