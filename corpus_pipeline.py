"""A pipeline from raw documents to packed training sequences; each stage is one operator of docgrove.llm.

Every stage but the last returns the columns of its input and works on whatever the stage before kept:

- toxicity: rows whose text scores at least the threshold go. Null and blank texts have the score of no evidence.
- near_duplicates: of each group of rows linked by a Jaccard similarity of 0.8 over shingles of five words one stays,
  that with the least id; of several with this id, one. Rows are decided by id and text, so a text that is in no other row
  stays whatever else stands under its id. Rows without an id take no part and stay, and so do all rows without words.
- personal_data: every span is replaced by its kind in brackets. Null stays null; n_chars, if there, is the new length.
- mixing: documents are taken as often as their source's budget has epochs for them.
- packing: pieces of documents and the sequences they lie in; the last stage.

An empty table passes through all stages as an empty one. Columns that `documents` does not have usually are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove.llm import harmonic_packing, jaccard_join, pii_semicrf, source_mixing, toxicity_zstd
from docgrove.llm.tables import free_name, keep, read_table

THRESHOLD = toxicity_zstd.THRESHOLD


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_zstd.toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_zstd.toxicity_column(model)(F.col("text")) < THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = keep(jaccard_join.jaccard_rows(docs).filter(F.col("doc_id").isNotNull()), "near_duplicates")
    words = found.filter(F.col("set_key").isNotNull()).select("doc_id", "set_key", "root")
    first = words.groupBy("root").agg(F.min(F.struct("doc_id", "set_key")).alias("first"))
    loses = words.join(first, "root").filter(F.struct("doc_id", "set_key") != F.col("first")).select("doc_id", "set_key").distinct()
    loses = keep(loses, "loses")
    # Ids with several rows, of which there are few as a rule, are decided row by row; all others by their id.
    repeated = keep(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    dropped = keep(loses.select("doc_id").unionByName(repeated).distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    key = free_name(docs, "set_key")
    again = docs.join(repeated, "doc_id", "left_semi").withColumn(key, jaccard_join.set_keys()(F.col("text")))
    blank = again.filter(F.col(key).isNull()).select(docs.columns)
    again = again.filter(F.col(key).isNotNull())
    again = again.join(loses.withColumnRenamed("set_key", key), ["doc_id", key], "left_anti")
    one = again.groupBy("doc_id", key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "text").alias("one"))
    return kept.unionByName(blank).unionByName(one.select("one.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.withColumn("text", pii_semicrf.mask_column(pii_semicrf.fit(docs))(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(docs, source_mixing.document_levels(), source_mixing.document_weights())
    return mixed.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]
#: Trained models and near duplicates are no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
