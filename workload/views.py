"""Inputs of the engine, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove import scratch
from docgrove.operators import matching
from docgrove.sources import taxonomy
from workload import rules

NODE_COLUMNS = [
    "node_token", "parent_node_token", "title", "obj_type", "obj_token", "has_child", "node_type", "url", "ord",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nodes(df: DataFrame, **columns: str) -> DataFrame:
    given = {"obj_type": "'docx'", "node_type": "'origin'", "url": "cast(null AS string)"} | columns
    return df.select(*[F.expr(given[c]).alias(c) for c in NODE_COLUMNS])


def _union(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions over nations over customers over orders, with suppliers as sheets under nations."""
    orders = table(spark, sf, "orders")
    buyers = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("buys", F.lit(True))
    customers = table(spark, sf, "customer").join(buyers, "c_custkey", "left")
    return _union(
        _nodes(
            table(spark, sf, "region"), node_token="'R' || r_regionkey", parent_node_token="cast(null AS string)",
            title="r_name", obj_token="'OR' || r_regionkey", has_child="true", ord="cast(r_regionkey AS bigint)",
        ),
        _nodes(
            table(spark, sf, "nation"), node_token="'N' || n_nationkey", parent_node_token="'R' || n_regionkey",
            title="n_name", obj_token="'ON' || n_nationkey", has_child="true", ord="cast(n_nationkey AS bigint)",
        ),
        _nodes(
            customers, node_token="'C' || c_custkey", parent_node_token="'N' || c_nationkey",
            title="c_name", obj_token="'OC' || c_custkey", has_child="coalesce(buys, false)", ord="2 * c_custkey",
        ),
        _nodes(
            orders, node_token="'O' || o_orderkey", parent_node_token="'C' || o_custkey",
            title="o_orderstatus || ' ' || o_orderpriority", obj_token="'OO' || o_orderkey", has_child="false",
            ord="o_orderkey",
        ),
        _nodes(
            table(spark, sf, "supplier"), node_token="'S' || s_suppkey", parent_node_token="'N' || s_nationkey",
            title="s_name", obj_type="'sheet'", obj_token="'OS' || s_suppkey", has_child="false",
            ord="2 * s_suppkey + 1",
        ),
    )


def doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Root over languages over sources over documents. Documents of some sources have a second node, under
    the first source of their language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    sources = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("first_id"))
    langs = sources.groupBy("lang").agg(F.min("first_id").alias("first_id"), F.min("source").alias("first_source"))
    second = docs.filter(rules.HAS_SECOND_NODE).join(langs.select("lang", "first_source"), "lang")
    root = spark.range(0, 1, 1, 1)
    return _union(
        _nodes(
            root, node_token=f"'{rules.DOCUMENT_ROOT}'", parent_node_token="cast(null AS string)",
            title="'Documents'", obj_token="'ODOCS'", has_child="true", ord="cast(0 AS bigint)",
        ),
        _nodes(
            langs, node_token="'L' || lang", parent_node_token=f"'{rules.DOCUMENT_ROOT}'", title="lang",
            obj_token="'OL' || lang", has_child="true", ord="first_id",
        ),
        _nodes(
            sources, node_token="'S' || lang || '/' || source", parent_node_token="'L' || lang", title="source",
            obj_token="'OS' || lang || '/' || source", has_child="true", ord="first_id",
        ),
        _nodes(
            docs, node_token=rules.DOC_NODE, parent_node_token="'S' || lang || '/' || source", title=rules.TITLE,
            obj_token=rules.DOC_OBJECT, has_child="false", ord="doc_id",
        ),
        _nodes(
            second, node_token=rules.SECOND_NODE, parent_node_token="'S' || lang || '/' || first_source",
            title=rules.TITLE, obj_token=rules.DOC_OBJECT, has_child="false", node_type="'shortcut'",
            ord="1000000000000000 + doc_id",
        ),
    )


def target_nodes(spark: SparkSession) -> DataFrame:
    """Folders that exist before: `Science` twice under the target, with a child each."""
    rows = [
        (rules.TARGET, None, "Target", 1),
        ("T1", rules.TARGET, "Science", 0),
        ("T2", rules.TARGET, "Science", 1),
        ("T3", "T2", "Physics", 0),
        ("T4", "T1", "Biology", 0),
    ]
    return _nodes(
        spark.createDataFrame(rows, "t string, p string, name string, pos bigint"), node_token="t",
        parent_node_token="p", title="name", obj_token="'O' || t", has_child="true", ord="pos",
    )


def space_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return doc_nodes(spark, sf).unionByName(target_nodes(spark))


def flat_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a top-level node that carries the name of its source."""
    return _nodes(
        table(spark, sf, "documents").select("doc_id", "lang", "source"), node_token=rules.DOC_NODE,
        parent_node_token="cast(null AS string)", title="lang || '/' || source", obj_token=rules.DOC_OBJECT,
        has_child="false", ord="doc_id",
    )


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    by_object = docs.select(
        F.expr(rules.DOC_OBJECT).alias("doc_id"),
        F.expr(rules.RESPONSE_CODE).alias("code"),
        F.expr(f"CASE WHEN {rules.IS_BLANK} THEN {rules.BLANK} WHEN ({rules.RESPONSE_CODE}) = 0 THEN text END").alias("content"),
        "source",
        F.lit(1).cast("bigint").alias("attempt"),
    )
    by_node = docs.filter(rules.ANSWERS_BY_NODE).select(
        F.expr(rules.DOC_NODE).alias("doc_id"), F.lit(0).alias("code"), F.col("text").alias("content"), "source",
        F.lit(1).cast("bigint").alias("attempt"),
    )
    before = docs.filter(rules.READ_BEFORE).select(
        F.expr(rules.DOC_OBJECT).alias("doc_id"), F.lit(0).alias("code"), F.expr("'earlier ' || text").alias("content"), "source",
        F.lit(0).cast("bigint").alias("attempt"),
    )
    return by_object.unionByName(by_node).unionByName(before).unionByName(by_object.filter(rules.EXPORTED_TWICE))


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """Content responses; some are blank, some only answer to the node, some to nothing, some are repeated."""
    return _contents(spark, sf).drop("source")


def content_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """`contents` as response bodies; those of one source are not JSON."""
    answer = F.to_json(
        F.struct(
            "code",
            F.when(F.col("code") == 0, F.lit("success")).otherwise(F.lit("not found")).alias("msg"),
            F.when(F.col("code") == 0, F.struct("content")).alias("data"),
        )
    )
    broken = F.expr(rules.ANSWERS_NO_JSON)
    return _contents(spark, sf).select("doc_id", "attempt", F.when(broken, F.lit("<html>busy</html>")).otherwise(answer).alias("body"))


def title_bodies(spark: SparkSession, sf: str) -> DataFrame:
    title = F.struct(F.struct(F.expr(rules.TITLE).alias("title")).alias("document"))
    known = F.struct(F.lit(0).alias("code"), title.alias("data"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    newest = docs.select(
        F.expr(rules.DOC_OBJECT).alias("doc_id"),
        F.lit(1).cast("bigint").alias("attempt"),
        F.when(F.expr(rules.ANSWERS_NOTHING), F.lit('{"code":1,"msg":"denied"}')).otherwise(F.to_json(known)).alias("body"),
    )
    earlier = F.lit('{"code":0,"data":{"document":{"title":"zzz earlier"}}}')
    before = docs.filter(rules.READ_BEFORE).select(
        F.expr(rules.DOC_OBJECT).alias("doc_id"), F.lit(0).cast("bigint").alias("attempt"), earlier.alias("body")
    )
    return newest.unionByName(before).unionByName(newest.join(before.select("doc_id"), "doc_id", "left_semi"))


def node_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Node lookups for every node."""
    nodes = doc_nodes(spark, sf).unionByName(tree_nodes(spark, sf))
    node = F.struct(F.struct("obj_token", "obj_type").alias("node"))
    return nodes.select("node_token", F.to_json(F.struct(F.lit(0).alias("code"), node.alias("data"))).alias("body"))


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All node tokens, and object tokens of documents, which no node has."""
    nodes = doc_nodes(spark, sf).unionByName(tree_nodes(spark, sf))
    objects = table(spark, sf, "documents").select(F.expr(rules.DOC_OBJECT).alias("node_token"))
    return nodes.select("node_token").unionByName(objects)


def listing_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """`doc_nodes` as listing calls of 70 places, and more children where places repeat. The parents of one language refuse, `has_child` is
    left out where it is false, and each page ends in an item without a token."""
    nodes = doc_nodes(spark, sf)
    denied = table(spark, sf, "documents").agg(F.max("lang")).scalar()
    item = F.struct(
        "node_token", "title", "obj_type", "obj_token",
        F.when(F.col("has_child"), F.lit(True)).alias("has_child"), "node_type", "url",
    )
    nameless = F.from_json(
        F.lit('{"title":"draft"}'),
        "node_token STRING, title STRING, obj_type STRING, obj_token STRING, has_child BOOLEAN, node_type STRING, url STRING",
    )
    pages = nodes.groupBy("parent_node_token", F.expr("ord % 1000000000000000 DIV 70").alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("ord", item.alias("item")))).alias("rows")
    )
    items = F.concat(F.transform("rows", lambda r: r["item"]), F.array(nameless))
    body = F.to_json(
        F.struct(F.lit(0).alias("code"), F.lit("success").alias("msg"),
                 F.struct(items.alias("items"), F.lit(False).alias("has_more")).alias("data"))
    )
    parent = F.coalesce("parent_node_token", F.lit(""))
    refused = (parent == F.concat(F.lit("L"), denied)) | parent.startswith(F.concat(F.lit("S"), denied, F.lit("/")))
    return pages.select(
        "parent_node_token", "page", F.when(refused, F.lit('{"code":1,"msg":"denied"}')).otherwise(body).alias("body")
    )


def labels(spark: SparkSession) -> DataFrame:
    return taxonomy.from_paths(spark.createDataFrame(list(enumerate(rules.LABELS)), "ord bigint, path string"))


def label_index(spark: SparkSession) -> DataFrame:
    return scratch.stage(matching.label_index(labels(spark)), scratch.new_folder(spark, "label-index"))


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A label tree found in the part table: brands over types over lists of sizes, each where it occurs first."""
    parts = table(spark, sf, "part")
    first = F.min("p_partkey").alias("ord")
    sizes = parts.groupBy("p_brand", "p_type", "p_size").agg(first)
    types = parts.groupBy("p_brand", "p_type").agg(first)
    brands = parts.groupBy("p_brand").agg(first)
    rows = _union(
        brands.selectExpr("p_brand id", "cast(null AS string) parent", "p_brand label", "ord", "false listed"),
        types.selectExpr("p_brand || '.' || p_type id", "p_brand parent", "p_type label", "ord", "false listed"),
        sizes.selectExpr(
            "p_brand || '.' || p_type || '.' || p_size id", "p_brand || '.' || p_type parent",
            "'size ' || p_size label", "ord", "true listed",
        ),
    )
    return taxonomy.from_adjacency(rows)


def catalogue_json(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of `catalogue` as one JSON object, labels in the order of their first part."""

    def quoted(text: str) -> Column:
        return F.to_json(F.array(text)).substr(F.lit(2), F.length(text) + 2)

    def listed(rows: DataFrame, item: Column, *by: str) -> DataFrame:
        inner = F.sort_array(F.collect_list(F.struct("ord", item.alias("item"))))
        joined = F.array_join(F.transform(inner, lambda x: x["item"]), ", ")
        return rows.groupBy(*by).agg(joined.alias("items"), F.min("ord").alias("ord"))

    parts = table(spark, sf, "part")
    sizes = parts.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_partkey").alias("ord"))
    sizes = sizes.withColumn("label", F.concat(F.lit("size "), "p_size"))
    types = listed(sizes, quoted("label"), "p_brand", "p_type")
    brands = listed(types, F.concat(quoted("p_type"), F.lit(": ["), "items", F.lit("]")), "p_brand")
    whole = listed(brands, F.concat(quoted("p_brand"), F.lit(": {"), "items", F.lit("}")))
    return whole.select(F.concat(F.lit("{"), "items", F.lit("}")).alias("value"))


def two_spaces(spark: SparkSession, sf: str) -> DataFrame:
    """The trees of orders and of documents, as two spaces of one table."""
    orders = tree_nodes(spark, sf).withColumn("space_id", F.lit("orders"))
    return orders.unionByName(doc_nodes(spark, sf).withColumn("space_id", F.lit("documents")))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress objects as JSON text, some hundred processed nodes in each."""
    docs = table(spark, sf, "documents").filter(rules.DONE_BEFORE).select("doc_id", F.expr(rules.DOC_NODE).alias("node"))
    files = docs.groupBy(F.expr("doc_id DIV 500").alias("file")).agg(F.collect_list("node").alias("processed_tokens"))
    kept = F.struct(
        "processed_tokens", F.size("processed_tokens").alias("total_processed"),
        F.lit("2024-03-01T10:00:00.5").alias("last_update"), F.lit(rules.DOCUMENT_ROOT).alias("scan_root"),
    )
    return files.select(F.to_json(kept).alias("value"))


def raw_responses(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.select(
        F.expr(rules.DOC_OBJECT).alias("obj_key"),
        F.expr(rules.RAW_RESPONSE).alias("raw_response"),
        F.expr(f"CASE WHEN {rules.FAILED} THEN 'RuntimeError: no answer' END").alias("error"),
    )


def cache(spark: SparkSession, sf: str, version) -> DataFrame:
    """Labels cached before: of some documents for the body they have now, of others for another one."""
    docs = table(spark, sf, "documents").filter(rules.IN_CACHE)
    current = F.expr(rules.CACHED_BODY_IS_CURRENT)
    return docs.select(
        F.expr(rules.DOC_OBJECT).alias("obj_token"),
        F.when(current, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit("!")), 256)).alias("content_hash"),
        version.alias("taxonomy_version"),
        F.lit(rules.CACHED_LABEL).alias("path"),
        F.lit('{"tag1":["Commerce"],"tag2":["Retail"]}').alias("tag_json"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("updated_at"),
    )


def ledger(spark: SparkSession, sf: str, scan_root: str = rules.DOCUMENT_ROOT) -> DataFrame:
    docs = table(spark, sf, "documents").filter(rules.DONE_BEFORE)
    return docs.select(
        F.expr(rules.DOC_NODE).alias("node_token"),
        F.lit(scan_root).alias("scan_root"),
        F.lit(rules.TARGET).alias("target_root"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("processed_at"),
    )
