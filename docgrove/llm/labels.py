"""A bounded sample of labelled documents to learn from, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove.llm.tables import keep, narrow

#: Labelled documents a model learns from at most: those with the least hash of their id. They fit into one task.
LEARN_MAX = 8000


def least_hashes(rows: DataFrame, value: Column, limit: int) -> DataFrame:
    """About the `limit` rows with the least hash of `value`, at least a quarter more where there are more: by a threshold
    from the number of rows, so that no task gathers a share of every partition. Rows are read twice."""
    share = min(1.0, 1.25 * limit / max(rows.count(), 1))
    if share == 1.0:
        return rows
    return rows.filter(F.xxhash64(value) < F.lit(int(2**64 * share) - 2**63))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for judging: crc32 of its id as text leaves 1 when divided by 3. No id: it is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_sample(docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id", text: str = "text",
                    limit: int = LEARN_MAX) -> DataFrame:
    """(text, label): at most `limit` labelled documents that are not held out, one for each id. Rows without an id or a
    label are passed over; of several labels or texts under one id the greatest counts; a null text is empty."""
    marked = narrow(labels, id_column, label).filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    marked = marked.filter(~held_out(F.col(id_column)))
    marked = least_hashes(marked, F.col(id_column), limit)
    chosen = marked.groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = keep(chosen.orderBy(F.xxhash64(id_column), id_column).limit(limit), "learn")
    texts = narrow(docs, id_column, text).join(chosen, id_column)
    one = texts.groupBy(id_column).agg(F.max(text).alias("text"), F.max("label").alias("label"))
    return one.select(id_column, F.coalesce("text", F.lit("")).alias("text"), "label")
