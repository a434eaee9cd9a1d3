"""Nearest neighbours by inner product with cross-polytope hashing.

A vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and hashed to the
nearest signed axis. Every table has a rotation of its own and holds every vector once. A query probes, in each table,
the `probes` axes it is nearest to. Vectors of unequal length first get one more component that makes all lengths equal,
so that the nearest axis follows the inner product and not the angle.

Candidates never become rows. The vectors of a bucket lie together, packed; a bucket with many is split into parts of about
PART vectors, and the queries that probe it go to each part. A task multiplies the queries of a part with its vectors in
double precision and keeps each query's best; the best of all parts are merged. A query that meets too few candidates
meets every vector in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove.llm.tables import keep

NEAREST, TABLES, PROBES = 20, 14, 8
#: With a component added to even out lengths the space is larger, so more tables are needed for the same recall.
UNEQUAL_TABLES, UNEQUAL_PROBES = 24, 8
PART = 2048
_AT_ONCE = 256


def _hadamard(x: np.ndarray) -> np.ndarray:
    half = 1
    while half < x.shape[1]:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), -1)
        half *= 2
    return x / np.sqrt(x.shape[1])


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Rows of x, filled up to a power of two, turned as for `table`."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng(table).choice([-1.0, 1.0], (3, size))
    for row in signs:
        x = _hadamard(x * row)
    return x


def nearest_axes(x: np.ndarray, table: int, many: int) -> np.ndarray:
    """The `many` nearest signed axes of each row, nearest first; axis i is 2i or, for its positive side, 2i + 1."""
    x = rotated(x, table)
    both = np.stack([-x, x], 2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :many]


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components there and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _best(found: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (ids, scores): greatest score first, ties to the smaller id, each id once."""
    ids, scores = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    ids, first = np.unique(ids, return_index=True)
    scores = scores[first]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _parts(vectors: DataFrame, queries: bool, size: int, longest: float | None, tables: int, probes: int, kind: str) -> DataFrame:
    """(t, bucket, first, n, ids, values, query): the vectors of a batch that share a bucket, packed in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), size)
            stored = x.astype(kind)
            hashed = x
            if longest is not None:
                # A query has nothing in the added component: it is to be near long vectors, not ones of its own length.
                added = np.zeros(len(x)) if queries else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
                hashed = np.hstack([x, added[:, None]])
            rows = []
            for table in range(tables):
                axes = nearest_axes(hashed, table, probes if queries else 1)
                place = np.repeat(np.arange(len(ids)), axes.shape[1])
                axes = axes.ravel()
                order = np.argsort(axes, kind="stable")
                axes, place = axes[order], place[order]
                begins = np.flatnonzero(np.r_[True, axes[1:] != axes[:-1]]).tolist() if len(axes) else []
                for a, b in zip(begins, [*begins[1:], len(axes)]):
                    for c in range(a, b, PART):
                        at = place[c : min(c + PART, b)]
                        rows.append((table, int(axes[a]), int(ids[at[0]]), len(at), ids[at].tobytes(), stored[at].tobytes()))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["t", "bucket", "first", "n", "ids", "vectors"])

    packed = vectors.mapInArrow(run, "t long, bucket long, first long, n long, ids binary, vectors binary")
    return packed.withColumn("query", F.lit(queries))


def _search(indexed: DataFrame, probing: DataFrame, size: int, k: int, kind: str) -> DataFrame:
    """(query_id, ids, scores): the best of each query in each part of each bucket that it probes."""
    counts = indexed.groupBy("t", "bucket").agg(F.expr(f"cast((sum(n) + {PART - 1}) div {PART} as long)").alias("parts"))
    counts = keep(counts, "parts")
    members = indexed.join(counts, ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("first", "t"), F.col("parts")))
    asked = probing.join(counts, ["t", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = members.drop("parts").unionByName(asked.drop("parts"))

    def multiply(table: pa.Table) -> pa.Table:
        is_query = np.array(table["query"].to_pylist(), bool)

        def gathered(mask):
            rows = table.filter(pa.array(mask))
            ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64)
            return ids, np.frombuffer(b"".join(rows["vectors"].to_pylist()), kind).reshape(-1, size).astype(np.float64)

        ids, x = gathered(~is_query)
        query_ids, q = gathered(is_query)
        repeated = len(np.unique(ids)) < len(ids)  # then more than k rows may be needed for k ids
        out = []
        for at in range(0, len(query_ids) if len(ids) else 0, _AT_ONCE):
            # Not BLAS: every product is summed in one order, whatever else is in the part.
            scores = np.einsum("qd,nd->qn", q[at : at + _AT_ONCE], x)
            for own, row in zip(query_ids[at : at + _AT_ONCE].tolist(), scores):
                if len(row) > k + 1 and not repeated:
                    least = np.partition(row, -(k + 1))[-(k + 1)]
                    near = np.flatnonzero(row >= least)
                else:
                    near = np.arange(len(row))
                near = near[ids[near] != own]
                best, value = _best([(ids[near], row[near])], k)
                if len(best):
                    out.append((own, best.tolist(), value.tolist()))
        query, near, value = zip(*out) if out else ((), (), ())
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table([pa.array(list(c), t) for c, t in zip((query, near, value), kinds)], names=["query_id", "ids", "scores"])

    return both.groupBy("t", "bucket", "part").applyInArrow(multiply, "query_id long, ids array<long>, scores array<double>")


def _merged(found: DataFrame, k: int) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        pairs = zip(table["ids"].to_pylist(), table["scores"].to_pylist())
        ids, scores = _best([(np.array(a, np.int64), np.array(b)) for a, b in pairs], k)
        own = pa.array([table["query_id"][0].as_py()] * len(ids), pa.int64())
        return pa.table({"query_id": own, "rank": pa.array(np.arange(1, len(ids) + 1), pa.int32()), "vec_id": ids, "score": scores})

    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", embedding: str = "embedding", k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `vectors` where is_query holds, the k others of greatest inner
    product found, in order; ties go to the smaller id. All others, if there are no more than k.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or of another
    length than most (the shorter, if two lengths are as frequent). Of rows that share an id, each is a vector; a
    neighbour's id is listed once, and no query finds its own id. Other columns are not read.
    """
    own = F.col(f"`{embedding}`")
    double = vectors.schema[embedding].dataType.elementType.typeName() != "float"
    kind = "<f8" if double else "<f4"
    own_query = is_query.alias("asks")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), own.alias("x"), own_query)
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("x")))
    shape = rows.groupBy(F.size("x").alias("size")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b)).alias("most"),
        F.min(F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b)).alias("least"),
    )
    shape = shape.orderBy(F.desc("n"), "size").first()
    if shape is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    even = shape["most"] <= shape["least"] * (1 + 1e-5)
    longest = None if even else float(np.sqrt(shape["most"]))
    tables, probes = (TABLES, PROBES) if even else (UNEQUAL_TABLES, UNEQUAL_PROBES)
    size = shape["size"]
    rows = rows.filter(F.size("x") == size)
    asking = rows.filter("asks")

    indexed = keep(_parts(rows.select("id", "x"), False, size, longest, tables, 1, kind), "index")
    probing = _parts(asking.select("id", "x"), True, size, longest, tables, probes, kind)
    found = keep(_merged(_search(indexed, probing, size, k, kind), k), "nearest")

    # Queries that met fewer than k others ask all buckets of one table, that is, every vector.
    met = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= k)
    short = keep(asking.select("id", "x").join(met, "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    axes = 2 << max(size - (longest is None), 0).bit_length()
    again = _search(indexed.filter("t = 0"), _parts(short, True, size, longest, 1, axes, kind), size, k, kind)
    again = keep(_merged(again, k), "again")
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
