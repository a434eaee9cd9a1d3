"""Documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100, exactly.

The incidence matrix (rows: distinct shingle sets, columns: shingles) times its transpose holds every overlap. Only
the part of the product that can reach the bound is formed:

1. Each row keeps its size-derived prefix: two sets whose overlap reaches `percent` of the union share one of the
   first n - ceil(n * percent / 100) + 1 shingles of each, in any order common to all. The order puts shingles of many
   documents last, so a passage that thousands share hardly ever stands in a prefix.
2. The prefix entries are dealt out by column block, packed as arrays; each block drops the columns with one entry.
3. Blocks of columns are multiplied with their transpose, each in one task: for every row the rows that share a column with it
   are counted up from the columns' lists. A pair is discarded when the larger set is too large for the smaller one, or when
   the least overlap both sizes ask for is above what the two can have: shingles are counted in BINS ranges of the hash, and
   no more than the lesser count of each range can be common. Only pairs that pass leave the task.
   A column that very many documents share is cut into groups of rows, and each pair of groups is multiplied by itself.
4. First a sample of columns is multiplied, and each row keeps its best partners there, a number of pairs linear in the rows. The
   links among them join nearly all that belongs together, however large a group of near copies is. Then all columns
   whose rows still lie in different components are multiplied in full. A link inside one component changes nothing, so no
   link between components is lost.
5. The pairs that are left are decided by their whole rows, dealt into blocks of bounded size.

Copies (equal sets) are one row throughout. The choice of the shingles that count as frequent only orders columns:
it decides how much work there is, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.components import components
from docgrove.llm.tables import forget, keep, narrow, shuffle_partitions
from docgrove.llm.words import release, shingle_sets, text_column

WIDTH, PERCENT = 5, 80
#: Entries of a column block while entries are gathered, about 25 bytes each.
BLOCK_ENTRIES = 1 << 18
#: Packed entries are flushed to their blocks when a task holds this many.
FLUSH_ENTRIES = 1 << 18
#: A shingle of so many documents is frequent; of those, the most frequent FREQUENT_MAX (2 MB) are moved last.
FREQUENT, FREQUENT_MAX = 8, 1 << 18
#: Sets and shingles of a block of rows when pairs are decided.
BLOCK_SETS, BLOCK_SHINGLES = 1 << 11, 1 << 21
#: Part of all hash values whose shingles are counted: prefixes lie below, but for texts made of frequent passages.
COUNTED = 0.35
#: Ranges of the hash in which a set's shingles are counted. A set with more than 255 in one of them has no counts, and passes.
BINS = 512
#: Entries of a block that is multiplied, and rows of a column from which on it is cut into groups.
PRODUCT_ENTRIES, GROUP_ROWS = 1 << 17, 1 << 13
#: The first product: one column in SAMPLE, PARTNERS rows looked at for each row, the best BEST of which are kept.
SAMPLE, PARTNERS, BEST = 8, 32, 2

_KEY = np.dtype([("a", ">u8"), ("b", ">u4")])


def _set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())[:12]


def _bins(values: np.ndarray) -> bytes:
    """How many of the values lie in each of BINS ranges of the hash, a byte each; empty if one does not fit."""
    counts = np.bincount((values >> np.uint64(55)).astype(np.int64), minlength=BINS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    """(id column's slice, shingles, bounds) of consecutive rows."""
    for batch in batches:
        texts = text_column(batch.column(1))
        for row, values, bounds in shingle_sets(texts, width):
            yield batch.column(0).slice(row, len(bounds) - 1), values, bounds
        del batch, texts  # else it would be held while the next one is read
    release()


def shingled(docs: DataFrame, id_column: str = "doc_id", text_column_: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, set_key, bins): the size of each document's shingle set, a 96-bit key of it, null when empty, and its
    counts by ranges of the hash."""

    def run(batches):
        for ids, values, bounds in _sets(batches, width):
            edges = bounds.tolist()
            keys = [_set_key(values[a:b]) if b > a else None for a, b in zip(edges, edges[1:])]
            bins = [_bins(values[a:b]) if b > a else None for a, b in zip(edges, edges[1:])]
            columns = [ids, pa.array(np.diff(bounds), pa.int64()), pa.array(keys, pa.binary()), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_shingles", "set_key", "bins"])

    return narrow(docs, id_column, text_column_).mapInArrow(run, f"`{id_column}` long, n_shingles long, set_key binary, bins binary")


def _packed(parts: list[tuple[np.ndarray, ...]], blocks: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row per block with the entries of `parts` as packed arrays."""
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    begins = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
    ends = np.r_[begins[1:], len(blocks)]
    columns = [pa.array(blocks[begins], pa.int64())]
    for part in parts:
        part = part[order]
        columns.append(pa.array([part[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["block", *names])


def _joined(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _frequent(docs: DataFrame, id_column: str, text: str, width: int, blocks: int) -> np.ndarray:
    """The most frequent shingles among those counted, rarest first. The counts cover all documents."""
    below = np.uint64(int(COUNTED * 2**64))

    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return _packed([values, counts.astype(np.int64)], (values % np.uint64(blocks)).astype(np.int64), ["grams", "counts"])

        for _, values, _ in _sets(batches, width):
            held.append(values[values < below])
            size += len(held[-1])
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        held, size = [], 0
        release()

    def total(table: pa.Table) -> pa.Table:
        values, counts = _joined(table["grams"], np.uint64), _joined(table["counts"], np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        sums = np.add.reduceat(counts, begins)
        often = sums >= FREQUENT
        return pa.table({"gram": values[begins][often].view(np.int64), "n": sums[often]})

    counted = narrow(docs, id_column, text).mapInArrow(count, "block long, grams binary, counts binary")
    often = counted.groupBy("block").applyInArrow(total, "gram long, n long")
    top = often.orderBy(F.desc("n"), "gram").limit(FREQUENT_MAX).toArrow()
    return top["gram"].to_numpy().view(np.uint64)[::-1].copy()


def _entries(docs: DataFrame, id_column: str, text: str, width: int, percent: int, frequent: np.ndarray, blocks: int) -> DataFrame:
    """(gram, key): the prefix entries of columns that have two or more, once for each distinct set."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(frequent)

    def prefixes(batches):
        often = sent.value
        by_value = np.argsort(often)
        ordered = often[by_value]
        held: list[tuple[np.ndarray, bytes]] = []
        seen: set[bytes] = set()
        size = 0

        def flush():
            grams = np.concatenate([h[0] for h in held])
            keys = np.repeat(np.frombuffer(b"".join(h[1] for h in held), _KEY), [len(h[0]) for h in held])
            to = (grams % np.uint64(blocks)).astype(np.int64)
            if len(ordered):
                hot = ordered[np.minimum(np.searchsorted(ordered, grams), len(ordered) - 1)] == grams
                # A frequent shingle's entries go to blocks by document too; those beyond `blocks` are kept whole.
                to[hot] = blocks + ((grams[hot] ^ keys["a"][hot].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            return _packed([grams, keys], to, ["grams", "keys"])

        for _, values, bounds in _sets(batches, width):
            edges = bounds.tolist()
            if len(ordered):
                at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
                is_often = ordered[at] == values
                sums = np.r_[0, np.cumsum(is_often)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                n = b - a
                length = n - (percent * n + 99) // 100 + 1
                grams, key = values[a:b], _set_key(values[a:b])
                if key in seen:
                    continue
                seen.add(key)
                if len(ordered) and sums[b] > sums[a]:
                    mask = is_often[a:b]
                    last = grams[mask][np.argsort(by_value[at[a:b][mask]])]
                    grams = np.concatenate([grams[~mask], last])
                held.append((grams[:length].copy(), key))
                size += length
            if size >= FLUSH_ENTRIES:
                yield flush()
                held, size = [], 0
                seen.clear()
        if size:
            yield flush()
        held, size = [], 0
        seen.clear()
        release()

    def shared(table: pa.Table) -> pa.Table:
        grams, keys = _joined(table["grams"], np.uint64), _joined(table["keys"], _KEY)
        order = np.lexsort((keys["b"], keys["a"], grams))
        grams, keys = grams[order], keys[order]
        fresh = np.r_[True, (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])]
        grams, keys = grams[fresh], keys[fresh]
        if table["block"][0].as_py() < blocks:
            same = grams[1:] == grams[:-1]
            many = np.r_[same, False] | np.r_[False, same]
            grams, keys = grams[many], keys[many]
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(keys), [None, pa.py_buffer(keys.tobytes())])
        return pa.table({"gram": grams.view(np.int64), "key": packed.cast(pa.binary())})

    dealt = narrow(docs, id_column, text).mapInArrow(prefixes, "block long, grams binary, keys binary")
    return dealt.groupBy("block").applyInArrow(shared, "gram long, key binary")


def _counts(bins: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have counts, and the counts, a row of BINS each; read in place where all have them."""
    held = pa.concat_arrays([pa.array([], pa.binary()), *bins.chunks])
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    exact = np.diff(offsets) > 0
    if exact.all():
        return exact, data.reshape(len(exact), BINS)
    counts = np.zeros((len(exact), BINS), np.uint8)
    counts[exact] = data.reshape(-1, BINS)
    return exact, counts


def _product(table: pa.Table, percent: int, full: bool) -> pa.Table:
    """The pairs of one block's rows that may be linked, at most BEST for each row unless `full`.

    table: key, grams (the row's columns in this block), n, label and bins."""
    table = table.combine_chunks()
    keys, n = table["key"].to_pylist(), table["n"].to_numpy()
    label = table["label"].combine_chunks().dictionary_encode().indices.to_numpy() if len(keys) else np.empty(0, np.int32)
    exact, counts = _counts(table["bins"])
    lists = table["grams"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), sizes)
    _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(column, kind="stable")
    members, firsts = row[order], np.searchsorted(column[order], np.arange(column.max() + 2 if len(column) else 1))
    ends, found_u, found_v = np.cumsum(sizes), [], []
    for i in range(len(keys)):
        lists_of = [members[firsts[c] : firsts[c + 1]] for c in column[ends[i] - sizes[i] : ends[i]].tolist()]
        others = np.concatenate(lists_of) if len(lists_of) > 1 else lists_of[0]
        others = np.unique(others[others > i] if full else others[others < i])
        others = others[(label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        if not len(others):
            continue
        if not full and len(others) > PARTNERS:  # the first ones, and others spread over the rest
            spread = PARTNERS // 2 + (np.arange(PARTNERS // 2) * (len(others) - PARTNERS // 2)) // (PARTNERS // 2)
            others = others[np.r_[0 : PARTNERS // 2, spread]]
        most = np.minimum(counts[others], counts[i]).sum(axis=1, dtype=np.int64)
        most = np.where(exact[others] & exact[i], most, n[i])
        left = (100 + percent) * most - percent * (n[others] + n[i])
        others, left = others[left >= 0], left[left >= 0]
        if not full:
            others = others[np.argsort(-left, kind="stable")[:BEST]]
        found_u += [keys[i]] * len(others)
        found_v += [keys[j] for j in others.tolist()]
    del table, lists, counts
    release()
    pairs = [(min(u, v), max(u, v)) for u, v in zip(found_u, found_v)]
    return pa.table({"u": pa.array([u for u, _ in pairs], pa.binary()), "v": pa.array([v for _, v in pairs], pa.binary())})


def _multiplied(entries: DataFrame, sets: DataFrame, percent: int, full: bool) -> DataFrame:
    """(u, v), u before v: pairs of rows that share a column of `entries` and may be linked. sets: key, n, label, bins."""
    blocks = max(1, entries.count() // PRODUCT_ENTRIES)
    wide = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > GROUP_ROWS)
    wide = keep(wide.select("gram", F.expr(f"rows div {GROUP_ROWS} + 1").alias("groups")), "wide")
    dealt = entries.join(wide, "gram", "left").withColumn("own", F.pmod(F.xxhash64("key", "gram"), F.col("groups")))
    # A group of rows meets itself and, in the full product, every other group of its column.
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda o: F.xxhash64("gram", F.least("own", o), F.greatest("own", o)))
    alone = F.array(F.xxhash64("gram", "own", "own"))
    one = F.array(F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    block = F.when(F.col("groups").isNull(), one).otherwise(cells if full else alone)
    rows = dealt.select("gram", "key", F.explode(block).alias("block"))
    rows = rows.groupBy("block", "key").agg(F.collect_list("gram").alias("grams")).join(sets, "key")
    rows = rows.select("block", "key", "grams", "n", "label", "bins")
    return rows.groupBy("block").applyInArrow(lambda table: _product(table, percent, full), "u binary, v binary").distinct()


def _full_rows(docs: DataFrame, id_column: str, text: str, width: int, wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, grams): the whole sets with the wanted keys, packed; computed again from the texts that have them."""

    def run(batches):
        for _, values, bounds in _sets(batches, width):
            edges = bounds.tolist()
            pairs = [(_set_key(values[a:b]), values[a:b].tobytes()) for a, b in zip(edges, edges[1:]) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], ["key", "grams"]
            )

    one = rows.join(wanted.withColumnRenamed("key", "set_key"), "set_key", "left_semi")
    ids = one.groupBy("set_key").agg(F.min(id_column).alias(id_column)).select(id_column).distinct()
    ids = keep(ids, "texts")
    plain = narrow(docs, id_column, text)
    # Rows without an id cannot be looked up by it, so all of them are taken.
    found = plain.join(ids.filter(F.col(id_column).isNotNull()), id_column, "left_semi")
    found = found.unionByName(plain.filter(F.col(id_column).isNull()))
    return found.mapInArrow(run, "key binary, grams binary").dropDuplicates(["key"]).join(wanted, "key", "left_semi")


def _links(pairs: DataFrame, full: DataFrame, blocks: int, percent: int) -> DataFrame:
    """Of the pairs (u, v), those whose overlap, accumulated over the whole rows, reaches the bound.

    Rows are dealt into blocks. A task has the pairs between two blocks and each of their sets once, so that a set with very
    many partners is not sent to each of them."""
    ends = [F.pmod(F.xxhash64(c), F.lit(blocks)).alias(f"block_{c}") for c in ("u", "v")]
    dealt = pairs.select(*ends, "u", "v")
    needed = [dealt.select("block_u", "block_v", F.col(c).alias("key")) for c in ("u", "v")]
    rows = needed[0].unionByName(needed[1]).distinct().join(full, "key")
    rows = rows.select("block_u", "block_v", F.col("key").alias("u"), F.lit(None).cast("binary").alias("v"), "grams")
    both = rows.unionByName(dealt.withColumn("grams", F.lit(None).cast("binary")))

    def count(table: pa.Table) -> pa.Table:
        sets, found = {}, []
        for u, v, grams in zip(table["u"].to_pylist(), table["v"].to_pylist(), table["grams"]):
            if v is None:
                sets[u] = np.frombuffer(grams.as_buffer(), np.uint64)
            else:
                found.append((u, v))
        linked = []
        for u, v in found:
            joined = np.concatenate([sets[u], sets[v]])
            joined.sort()
            overlap = int(np.count_nonzero(joined[1:] == joined[:-1]))
            if 100 * overlap >= percent * (len(joined) - overlap):
                linked.append((u, v))
        sets.clear()
        del table
        release()
        return pa.table({"u": pa.array([u for u, _ in linked], pa.binary()), "v": pa.array([v for _, v in linked], pa.binary())})

    return both.groupBy("block_u", "block_v").applyInArrow(count, "u binary, v binary")


def set_components(docs: DataFrame, rows: DataFrame, id_column: str = "doc_id", text: str = "text",
                   width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, root) over the keys of distinct sets that are linked; rows: what `shingled` returned, staged."""
    spark = docs.sparkSession
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(shuffle_partitions(spark), int(total * max(COUNTED, 1 - percent / 100) / BLOCK_ENTRIES) + 1)
    frequent = _frequent(docs, id_column, text, width, blocks)
    entries = keep(_entries(docs, id_column, text, width, percent, frequent, blocks), "entries")
    named = rows.filter("set_key is not null").select(F.col("set_key").alias("key"), F.col("n_shingles").alias("n"), "bins")
    met = named.join(entries.select("key").distinct(), "key", "left_semi")
    sets = keep(met.groupBy("key").agg(F.first("n").alias("n"), F.first("bins").alias("bins")), "sets")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        wanted = keep(pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct(), "keys")
        size = sets.join(wanted, "key", "left_semi").agg(F.count(F.lit(1)), F.sum("n")).first()
        parts = max(size[0] // BLOCK_SETS, (size[1] or 0) // BLOCK_SHINGLES) + 1
        found = keep(_links(pairs, _full_rows(docs, id_column, text, width, wanted, rows), parts, percent), "overlaps")
        forget(pairs)
        forget(wanted)
        return found

    sample = entries.filter(F.pmod(F.xxhash64("gram", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)
    roots = components(linked(_multiplied(sample, sets.withColumn("label", F.col("key")), percent, False), sets))
    labels = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("root", "key"))
    labels = keep(labels.select("key", "n", "label", "bins"), "labels")
    of = entries.join(labels.select("key", "label"), "key")
    mixed = of.groupBy("gram").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("gram")
    left = keep(entries.join(mixed, "gram", "left_semi"), "mixed")
    forget(sets)
    forget(entries)
    rest = linked(_multiplied(left, labels, percent, True), labels)
    forget(left)
    return components(rest.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def set_keys(width: int = WIDTH):
    """An Arrow UDF from text to the key of its shingle set, null without words."""

    @F.arrow_udf("binary")
    def keys(texts: pa.Array) -> pa.Array:
        found: list[bytes | None] = []
        for _, values, bounds in shingle_sets(text_column(texts), width):
            edges = bounds.tolist()
            found += [_set_key(values[a:b]) if b > a else None for a, b in zip(edges, edges[1:])]
        release()
        return pa.array(found, pa.binary())

    return keys


def jaccard_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, set_key, root (one set of its component, the same for all of it) and component_id;
    the two in the middle are null without shingles. See `jaccard_components`."""
    rows = keep(shingled(docs, id_column, text, width), "shingled")
    roots = set_components(docs, rows, id_column, text, width, percent)
    least = rows.filter("set_key is not null").groupBy("set_key").agg(F.min(id_column).alias("least"))
    named = least.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    named = keep(named, "classes")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = keep(named.join(smallest, "root").select("set_key", "root", "component_id"), "class_ids")
    joined = rows.join(classes, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col(id_column)).otherwise(F.col("component_id"))
    return joined.select(id_column, "n_shingles", "set_key", "root", own.alias("component_id"))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH,
                       percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, the least id reachable over links, itself included.

    Null or blank texts have no shingles and are linked with nothing. A row without an id has a result like any other;
    its component is the least id of the others, null if there is none. Repeated rows each have a row.
    Texts are taken whole, however long. An empty table gives an empty result. Other columns of `docs` are not read.
    """
    return jaccard_rows(docs, id_column, text, width, percent).select(id_column, "n_shingles", "component_id")
