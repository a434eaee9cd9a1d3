"""Pending documents and their bodies.

Bodies are by far the widest column. Which response a document takes is decided on narrow columns;
the bodies themselves are shuffled once, to the documents that need them. Of repeated responses the newest
successful one counts, and it is the body of that one that is attached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove.functions.text import content_hash, has_body
from docgrove.sources.responses import attempt

OK, EMPTY, MISSING = "ok", "empty", "missing"


def _one_per_token(infos: DataFrame) -> DataFrame:
    """The newest lookup of each node."""
    newest = F.struct(attempt(infos).alias("attempt"), "obj_type", "obj_token")
    return infos.groupBy("node_token").agg(F.max(newest).alias("info"))


def _document_id(info):
    return F.when((info["obj_type"] == "docx") & (info["obj_token"] != ""), info["obj_token"])


def resolve_strict(tokens: DataFrame, infos: DataFrame) -> DataFrame:
    """Document id of each `node_token`; null unless the node is known and a document."""
    return tokens.join(_one_per_token(infos), "node_token", "left").select(
        *tokens.columns, _document_id(F.col("info")).alias("document_id")
    )


def resolve_lenient(tokens: DataFrame, infos: DataFrame) -> DataFrame:
    """Like `resolve_strict`, but an unknown token is taken for a document id itself."""
    info = F.col("info")
    return tokens.join(_one_per_token(infos), "node_token", "left").select(
        *tokens.columns,
        F.when(info.isNull(), F.col("node_token")).otherwise(_document_id(info)).alias("document_id"),
    )


def pending(leaves: DataFrame, processed: DataFrame) -> DataFrame:
    return leaves.join(processed.select("node_token"), "node_token", "left_anti")


def with_obj_key(leaves: DataFrame) -> DataFrame:
    """Key of a document: its object, or the node where that is not known."""
    return leaves.withColumn("obj_key", F.coalesce(F.nullif("obj_token", F.lit("")), "node_token"))


def dedupe_objects(leaves: DataFrame) -> DataFrame:
    """One node per document, the last in queue order. An aggregate rather than a window: many nodes of
    one document are reduced before the shuffle."""
    keyed = with_obj_key(leaves)
    carried = [c for c in keyed.columns if c not in ("obj_key", "parent_place", "ord")]
    last = F.max(F.struct("parent_place", "ord", *carried))
    return keyed.groupBy("obj_key").agg(last.alias("last")).select("obj_key", "last.*")


def _answered(contents: DataFrame) -> DataFrame:
    """The newest successful response of each document, without its body, and how many there are. The hash is null for
    a blank body; it is taken from the table if it was stored at ingest, and bodies are then not read at all."""
    body = F.col("content")
    stored = "content_hash" in contents.columns
    digest = F.col("content_hash") if stored else F.when(has_body(body), content_hash(body))
    read = F.struct(attempt(contents).alias("attempt"), digest.alias("hash")).alias("read")
    newest = contents.filter("code = 0").select("doc_id", read).groupBy("doc_id")
    newest = newest.agg(F.max("read").alias("read"), F.count(F.lit(1)).alias("responses"))
    return newest.select("doc_id", "read.attempt", "read.hash", "responses")


def read_status(docs: DataFrame, contents: DataFrame, infos: DataFrame | None = None) -> DataFrame:
    """`docs`, with `obj_key` and `node_token`, each pair once, plus `response_id`, `response_attempt`, `responses` (how
    many successful ones it has), `read_status`, `content_hash`.

    A document asks by its object, then by its node, then by the object its node resolves to. The first that
    has a successful response counts, even if its body is blank. Bodies are at most hashed in the scan, not moved.
    """
    asks = [F.col("obj_key"), F.col("node_token")]
    asking = docs
    if infos is not None:
        asking = resolve_strict(docs, infos)
        asks.append(F.col("document_id"))
    asked = asking.select(
        *docs.columns, F.posexplode(F.array_compact(F.array_distinct(F.array(*asks)))).alias("rank", "doc_id")
    )
    answered = _answered(contents)
    answer = F.when(F.col("responses") > 0, F.struct("rank", "doc_id", "attempt", "hash", "responses"))
    return (
        asked.join(answered, "doc_id", "left")
        .groupBy(*docs.columns)
        .agg(F.min(answer).alias("answer"))
        .select(
            *docs.columns,
            F.col("answer.doc_id").alias("response_id"),
            F.col("answer.attempt").alias("response_attempt"),
            F.coalesce("answer.responses", F.lit(0)).alias("responses"),
            F.when(F.col("answer").isNull(), F.lit(MISSING))
            .when(F.col("answer.hash").isNotNull(), F.lit(OK))
            .otherwise(F.lit(EMPTY))
            .alias("read_status"),
            F.col("answer.hash").alias("content_hash"),
        )
    )


def attach_contents(docs: DataFrame, contents: DataFrame, how: str = "left", repeated: bool = True) -> DataFrame:
    """Bodies of documents with a `response_id` and `response_attempt`; null for a blank body or none. With
    `how="inner"`, only documents with a response stay, and a small `docs` can be broadcast instead of moving the bodies.

    `repeated` says that responses may agree in id and attempt: one is taken, that whose hash was taken. Where every
    document has one response (`repeats` is false), False saves the aggregate."""
    body = F.col("content")
    bodies = contents.filter("code = 0").select(
        F.col("doc_id").alias("answered_by"), attempt(contents).alias("answered_at"), F.when(has_body(body), body).alias("body")
    )
    if repeated:
        hashed = F.struct(F.when(F.col("body").isNotNull(), content_hash(F.col("body"))).alias("hash"), "body")
        bodies = bodies.groupBy("answered_by", "answered_at").agg(F.max(hashed).alias("one"))
        bodies = bodies.select("answered_by", "answered_at", F.col("one.body").alias("body"))
    # No response answers to the node of a document without one: as a key it keeps such rows apart.
    key = F.coalesce("response_id", "node_token") if how == "left" else F.col("response_id")
    # The attempts are compared as a difference, so that the id alone is the join's key: contents laid out by it stay there.
    same = (key == F.col("answered_by")) & (F.col("response_attempt") - F.col("answered_at") == 0)
    return docs.join(bodies, same, how).select(*docs.columns, F.col("body").alias("content"))


def repeats(status: DataFrame) -> bool:
    """Whether any document has several successful responses; status is staged and narrow."""
    return not status.filter(F.col("responses") > 1).isEmpty()


def read_contents(docs: DataFrame, contents: DataFrame, infos: DataFrame | None = None) -> DataFrame:
    """Documents with their bodies; null where there is none."""
    return attach_contents(read_status(docs, contents, infos), contents)


def listings(leaves: DataFrame) -> DataFrame:
    """`(obj_key, node_token, listed)`: how often each node of a document was listed. Every listing is read
    by itself, so counts of reads are sums of `listed`."""
    return with_obj_key(leaves).groupBy("obj_key", "node_token").agg(F.count(F.lit(1)).alias("listed"))


def read_summary(status: DataFrame) -> DataFrame:
    """One row from the `read_status` of `listings`: documents read, with a body, without, without a response."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("listed"))), F.lit(0))

    outcome = F.col("read_status")
    return status.agg(
        total(F.lit(True)).alias("total"),
        total(outcome == OK).alias("ok"),
        total(outcome != OK).alias("empty"),
        total(outcome == MISSING).alias("missing"),
    )


def nonblank(docs: DataFrame, column: str = "content") -> DataFrame:
    return docs.filter(has_body(F.col(column)))
