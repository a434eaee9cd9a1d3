"""Exported API responses -> node, content, title and node-info tables.

The exports are JSON lines or parquet rows that hold the call's arguments and the response body.
Bodies are parsed where they are; a failed call or an unreadable body becomes an error row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.functions.text import content_hash, has_body

#: Bits of `ord` for the position in a page; the page stands above them, so no page is too long.
POSITION_BITS = 32
UNREADABLE = "body is not JSON"


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with one response each; see `schemas.*_RESPONSES`."""
    return spark.read.schema(schema).json(path)


def _parsed(responses: DataFrame, body_schema: str) -> DataFrame:
    return responses.withColumn("response", F.from_json("body", body_schema))


def attempt(responses: DataFrame) -> Column:
    """Which of repeated calls a response belongs to; 0 in a table that does not say, or says null."""
    return F.coalesce("attempt", F.lit(0)).cast("bigint") if "attempt" in responses.columns else F.lit(0).cast("bigint")


def _failure(response: Column) -> Column:
    return F.when(response["code"].isNull(), F.lit(UNREADABLE)).otherwise(response["msg"])


def listing_nodes(responses: DataFrame) -> DataFrame:
    """Node table (`schemas.NODES`) of all successful listing calls."""
    # The condition on the code stands in the generator: as a filter it would parse every body twice.
    items = F.when(F.col("response.code") == 0, F.col("response.data.items"))
    listed = _parsed(responses, schemas.LISTING_BODY).select(
        "parent_node_token", "page", F.posexplode(items).alias("pos", "item")
    )
    return listed.filter(F.coalesce(F.col("item.node_token"), F.lit("")) != "").select(
        "item.node_token",
        "parent_node_token",
        "item.title",
        "item.obj_type",
        "item.obj_token",
        F.coalesce("item.has_child", F.lit(False)).alias("has_child"),
        "item.node_type",
        "item.url",
        (F.shiftleft(F.col("page").cast("bigint"), POSITION_BITS) + F.col("pos")).alias("ord"),
    )


def listing_errors(responses: DataFrame) -> DataFrame:
    """Listing calls that brought no children, and why: their subtrees are missing from a walk."""
    parsed = _parsed(responses, schemas.LISTING_BODY)
    return parsed.filter(~F.coalesce(F.col("response.code") == 0, F.lit(False))).select(
        "parent_node_token", "page", "response.code", _failure(F.col("response")).alias("msg")
    )


def contents(responses: DataFrame) -> DataFrame:
    """Content table (`schemas.CONTENTS`): blank and failed bodies are null, the code tells them apart.
    Hashing at ingest lets later runs decide about documents without reading bodies."""
    body = F.col("response.data.content")
    read = _parsed(responses, schemas.CONTENT_BODY).select(
        "doc_id",
        attempt(responses).alias("attempt"),
        "response.code",
        _failure(F.col("response")).alias("msg"),
        F.when((F.col("response.code") == 0) & has_body(body), body).alias("content"),
    )
    return read.withColumn("content_hash", F.when(F.col("content").isNotNull(), content_hash(F.col("content"))))


def titles(responses: DataFrame) -> DataFrame:
    """`(doc_id, title)`, one row per document: of its newest successful call, null where none succeeded."""
    known = F.coalesce(F.col("response.code") == 0, F.lit(False)).alias("known")
    title = F.col("response.data.document.title").alias("title")
    read = _parsed(responses, schemas.DOCUMENT_BODY)
    read = read.select("doc_id", F.struct(known, attempt(responses).alias("attempt"), title).alias("read"))
    newest = read.groupBy("doc_id").agg(F.max("read").alias("read"))
    return newest.select("doc_id", F.when(F.col("read.known"), F.col("read.title")).alias("title"))


def node_infos(responses: DataFrame) -> DataFrame:
    """`(node_token, attempt, obj_type, obj_token)` of the nodes that could be looked up."""
    found = F.when(F.col("response.code") == 0, F.array("response.data.node"))
    nodes = _parsed(responses, schemas.NODE_BODY).select(
        "node_token", attempt(responses).alias("attempt"), F.explode(found).alias("node")
    )
    return nodes.select("node_token", "attempt", "node.obj_type", "node.obj_token")
