"""One Spark query per operator, over the given tables. Results are flat, so that they can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove import schemas, scratch
from docgrove.functions import labels, text
from docgrove.operators import classify, reading, route, tree
from docgrove.plans.run import Inputs, Settings, commit_bodies, commit_parts, run
from docgrove.sources import responses, tables, taxonomy
from workload import rules, views
from workload.stub import stub_provider

VERSION = "v1"
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _place(column: str = "ord_path") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), "/").alias(column)


# Sources


@query
def ingest_listing(spark: SparkSession, sf: str) -> DataFrame:
    nodes = responses.listing_nodes(views.listing_bodies(spark, sf))
    return nodes.select("node_token", "parent_node_token", "title", "obj_type", "obj_token", "has_child", "node_type", "ord")


@query
def ingest_listing_errors(spark: SparkSession, sf: str) -> DataFrame:
    return responses.listing_errors(views.listing_bodies(spark, sf))


@query
def ingest_content(spark: SparkSession, sf: str) -> DataFrame:
    read = responses.contents(views.content_bodies(spark, sf))
    return read.select("doc_id", "code", "msg", F.length("content").cast("bigint").alias("n_chars"), "content_hash")


@query
def doc_title(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.doc_nodes(spark, sf).select("node_token", F.col("obj_token").alias("doc_id"))
    found = docs.join(responses.titles(views.title_bodies(spark, sf)), "doc_id", "left")
    return found.select("node_token", "doc_id", "title")


@query
def resolve_strict(spark: SparkSession, sf: str) -> DataFrame:
    infos = responses.node_infos(views.node_bodies(spark, sf))
    return reading.resolve_strict(views.tokens(spark, sf), infos)


@query
def resolve_lenient(spark: SparkSession, sf: str) -> DataFrame:
    infos = responses.node_infos(views.node_bodies(spark, sf))
    return reading.resolve_lenient(views.tokens(spark, sf), infos)


@query
def taxonomy_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree_rows = views.catalogue(spark, sf)
    return tree_rows.select(_place(), "path", "parent_path", "depth", "is_leaf", "listed")


@query
def taxonomy_json(spark: SparkSession, sf: str) -> DataFrame:
    """The label tree from nested JSON, whose order of keys counts."""
    rows = taxonomy.from_json_text(views.catalogue_json(spark, sf))
    return rows.select(_place(), "path", "parent_path", "depth", "is_leaf", "listed")


# Hierarchy


def _walk(spark: SparkSession, sf: str) -> tree.Walk:
    return tree.walk(views.space_nodes(spark, sf), rules.DOCUMENT_ROOT)


def _leaves(spark: SparkSession, sf: str, walked: tree.Walk | None = None) -> DataFrame:
    return tree.leaf_documents((walked or _walk(spark, sf)).rows)


@query
def tree_walk(spark: SparkSession, sf: str) -> DataFrame:
    walked = tree.walk(views.tree_nodes(spark, sf), "R1")
    return walked.rows.select("node_token", "parent_node_token", "title", "depth", "parent_place", "ord")


@query
def tree_walk_all(spark: SparkSession, sf: str) -> DataFrame:
    walked = tree.walk(views.tree_nodes(spark, sf))
    return walked.rows.select("node_token", "parent_node_token", "title", "depth", "parent_place", "ord")


@query
def tree_walk_space(spark: SparkSession, sf: str) -> DataFrame:
    """One of two spaces, from the top."""
    walked = tree.walk(views.two_spaces(spark, sf), space_id="documents")
    return walked.rows.select("node_token", "parent_node_token", "title", "depth", "parent_place", "ord")


@query
def bfs_order(spark: SparkSession, sf: str) -> DataFrame:
    return _leaves(spark, sf).orderBy(*tree.BFS_ORDER).select("node_token", "obj_token", "title", "depth", "parent_place", "ord")


@query
def leaf_docs(spark: SparkSession, sf: str) -> DataFrame:
    walked = tree.walk(views.tree_nodes(spark, sf))
    return tree.leaf_documents(walked.rows).select("node_token", "obj_token", "title")


@query
def scan_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tree.scan_stats(tree.walk(views.tree_nodes(spark, sf)))


@query
def find_by_title(spark: SparkSession, sf: str) -> DataFrame:
    return tree.find_by_title(views.flat_nodes(spark, sf), "en/src7")


@query
def resolve_root(spark: SparkSession, sf: str) -> DataFrame:
    choices = {
        "scan by token": tree.scan_root_choice(token="K5", name="en/src7"),
        "scan by name": tree.scan_root_choice(name="en/src7"),
        "target by name": tree.target_root_choice(name="de/src3"),
        "target by fallback name": tree.target_root_choice(name="nowhere", fallback="fr/src1", token_prefix="Fb"),
        "target by fallback token": tree.target_root_choice(name="nowhere", fallback="Fb123", token_prefix="Fb"),
        "target nowhere": tree.target_root_choice(name="nowhere"),
    }
    found = tree.choose(views.flat_nodes(spark, sf), **choices)
    rows = F.array(*[F.struct(F.lit(c).alias("choice"), F.col(f"`{c}`").alias("node_token")) for c in choices])
    return found.select(F.explode(rows).alias("row")).select("row.*")


@query
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The whole document tree is known from before under old titles; a walk of one language renews its part."""
    nodes = views.doc_nodes(spark, sf)
    before = nodes.select(
        "node_token", "parent_node_token", F.concat(F.lit("old "), "title").alias("title"), "obj_type", "has_child",
        "node_type", F.expr("timestamp'2024-01-01 00:00:00'").alias("scan_time"),
    )
    folder = scratch.new_folder(spark, "snapshot")
    tables.upsert_snapshot(before.withColumn("place", F.struct(F.lit(0))), folder)
    walked = tree.walk(nodes, "Len").rows
    tables.upsert_snapshot(tables.snapshot_rows(walked, F.expr("timestamp'2024-02-01 00:00:00'")), folder)
    return tables.read_snapshot(spark, folder).select("node_token", "parent_node_token", "title", "has_child", F.month("scan_time").alias("scan_month"))


@query
def scan_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf sets of two scans are kept; one of them is taken up again."""
    nodes = views.doc_nodes(spark, sf)
    folder = scratch.new_folder(spark, "leaf-sets")
    for root in ("Len", rules.DOCUMENT_ROOT):
        tables.save_leaf_set(tree.leaf_documents(tree.walk(nodes, root).rows), folder, "007", root)
    stored = tables.load_leaf_set(spark, folder, "007", "Len")
    return stored.select("node_token", "obj_token", "title", "depth", "parent_place", "ord")


@query
def child_map(spark: SparkSession, sf: str) -> DataFrame:
    return tree.child_map(views.tree_nodes(spark, sf))


@query
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return tree.duplicate_titles(views.doc_nodes(spark, sf).unionByName(views.tree_nodes(spark, sf)))


@query
def name_check(spark: SparkSession, sf: str) -> DataFrame:
    """Is the title of each document taken under the source `src0` of its language?"""
    docs = views.table(spark, sf, "documents").select("lang", F.expr(rules.TITLE).alias("title"))
    wanted = docs.select(F.concat(F.lit("S"), "lang", F.lit("/src0")).alias("parent_key"), "title")
    return tree.check_titles(views.doc_nodes(spark, sf), wanted)


@query
def title_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tree.title_counts(views.doc_nodes(spark, sf).unionByName(views.tree_nodes(spark, sf)))


# Filters, limits, joins


def _read(spark: SparkSession, sf: str, walked: tree.Walk | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending documents, each once, with the content and node-info tables."""
    last = reading.dedupe_objects(_pending(spark, sf, walked))
    docs = last.select("obj_key", "node_token", "title", "obj_type", "obj_token")
    infos = views.space_nodes(spark, sf).select("node_token", "obj_type", "obj_token")
    return docs, views.contents(spark, sf), infos


def _pending(spark: SparkSession, sf: str, walked: tree.Walk | None = None) -> DataFrame:
    done = tables.processed_nodes(views.ledger(spark, sf), rules.DOCUMENT_ROOT)
    return reading.pending(_leaves(spark, sf, walked), done)


@query
def nonblank_docs(spark: SparkSession, sf: str) -> DataFrame:
    return reading.nonblank(views.contents(spark, sf)).select("doc_id", F.length("content").cast("bigint").alias("n_chars"))


@query
def limit_then_pending(spark: SparkSession, sf: str) -> DataFrame:
    first = tree.first_documents(_leaves(spark, sf), 100)
    done = tables.processed_nodes(views.ledger(spark, sf), rules.DOCUMENT_ROOT)
    return reading.pending(first, done).select("node_token", "obj_token", "depth", "parent_place", "ord")


@query
def pending_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _pending(spark, sf).select("node_token", "obj_token", "title", "depth", "parent_place", "ord")


@query
def dedupe_obj(spark: SparkSession, sf: str) -> DataFrame:
    return reading.dedupe_objects(_leaves(spark, sf)).select("obj_key", "node_token", "title")


@query
def read_contents(spark: SparkSession, sf: str) -> DataFrame:
    read = reading.read_contents(*_read(spark, sf))
    return read.select(
        "obj_key", "node_token", "title", "response_id", "read_status", "content_hash",
        F.sha2("content", 256).alias("body_hash"), F.length("content").cast("bigint").alias("n_chars"),
    )


@query
def content_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents laid out in parts; the bodies of all documents as four commits read them, each from the files of its own parts."""
    docs, bodies, infos = _read(spark, sf)
    status = scratch.stage(reading.read_status(docs, bodies, infos), scratch.new_folder(spark, "status"))
    folder = scratch.new_folder(spark, "content-parts")
    tables.save_content_parts(bodies, folder, 8)
    inputs = Inputs(docs, spark.read.parquet(folder), docs, stub_provider, content_parts=8)
    read = status.filter(F.col("read_status") == reading.OK)
    parts = [commit_bodies(inputs, read, some, 8, True) for some in commit_parts(inputs, Settings("", "", "", commits=4))]
    return views._union(*parts).select("obj_key", "node_token", "response_id", F.sha2("content", 256).alias("body_hash"))


@query
def read_summary(spark: SparkSession, sf: str) -> DataFrame:
    listed = reading.listings(_pending(spark, sf))
    return reading.read_summary(reading.read_status(listed, views.contents(spark, sf)))


# Classification


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return views.contents(spark, sf).select("doc_id", text.content_hash(F.col("content")).alias("content_hash"))


def _looked_up(spark: SparkSession, sf: str, walked: tree.Walk | None = None) -> DataFrame:
    docs, bodies, infos = _read(spark, sf, walked)
    status = reading.read_status(docs, bodies, infos)
    return classify.cache_lookup(status, views.cache(spark, sf, F.lit(VERSION)), VERSION)


@query
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _looked_up(spark, sf).select("obj_key", "node_token", "read_status", "cached_path")


@query
def cache_import(spark: SparkSession, sf: str) -> DataFrame:
    """Tags as JSON text, with the labels of `raw_responses`, taken over as cache rows."""
    kept = _labelled(spark, sf).select(
        F.col("obj_key").alias("obj_token"), F.lit("hash").alias("content_hash"),
        labels.tag_json(F.col("parts")).alias("tag_json"), F.lit("2024-02-01T10:00:00.123456").alias("updated_at"),
    )
    taken = tables.cache_from_tags(kept, VERSION)
    return taken.select("obj_token", "path", "tag_json", F.hour("updated_at").alias("updated_hour"))


@query
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select(
        F.expr(rules.DOC_OBJECT).alias("obj_key"), text.content_hash(F.col("text")).alias("content_hash")
    )
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    fresh = classify.cache_rows(found.join(docs, "obj_key"), VERSION, F.expr("timestamp'2024-02-01 00:00:00'"))
    after = tables.upsert(views.cache(spark, sf, F.lit(VERSION)), fresh, "obj_token", F.col("updated_at"))
    return after.select("obj_token", "content_hash", "path", "tag_json", F.month("updated_at").alias("updated_month"))


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    """Every document; those of one source have no title."""
    docs = views.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    title = F.when(F.expr(rules.UNTITLED), F.lit("")).otherwise(F.expr(rules.TITLE))
    return docs.select(F.expr(rules.DOC_OBJECT).alias("obj_key"), title.alias("title"), F.col("text").alias("content"))


@query
def prepare_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts under their titles."""
    whole = text.prepare_text(F.col("content"), F.col("title"))
    return _titled(spark, sf).select(
        "obj_key",
        F.length(whole).cast("bigint").alias("n_chars"),
        F.sha2(whole, 256).alias("text_hash"),
    )


@query
def taxonomy_outline(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.outline_lines(views.catalogue(spark, sf)).select(_place(), "line")


@query
def prompt_len(spark: SparkSession, sf: str) -> DataFrame:
    prepared = text.prepare_text(F.col("content"), F.col("title"))
    outline = taxonomy.outline(views.catalogue(spark, sf))
    # A subquery may not stand inside every function, and is one value: its length is taken from a column.
    titled = _titled(spark, sf).withColumn("outline", outline)
    length = text.request_length(rules.REQUEST_TEMPLATE, outline=F.col("outline"), text=prepared)
    return titled.select("obj_key", length.alias("n_chars"))


@query
def classify_stub(spark: SparkSession, sf: str) -> DataFrame:
    """Every document through the model, whose answers come from Python."""
    requests = classify.model_requests(_titled(spark, sf))
    answers = scratch.stage(classify.call_model(requests, stub_provider), scratch.new_folder(spark, "answers"))
    found = classify.label_answers(answers, views.label_index(spark))
    return found.select("obj_key", "raw_response", "error", "path", "match_tier")


@query
def clean_response(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.raw_responses(spark, sf)
    return raw.select("obj_key", "raw_response", text.clean_response(F.col("raw_response")).alias("answer"))


@query
def validate_path(spark: SparkSession, sf: str) -> DataFrame:
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    return found.groupBy("answer", "path", "match_tier").agg(F.count(F.lit(1)).alias("documents"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    return route.route_columns(found.filter("error is null"))


@query
def path_to_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = labels.tag_map(F.col("parts"))
    return _labelled(spark, sf).select(
        "obj_key", F.size(tags).alias("levels"), labels.tag_json(F.col("parts")).alias("tag_json"),
        *[F.try_element_at(tags, F.lit(f"tag{n}"))[0].alias(f"tag{n}") for n in (1, 2, 3, 4)],
    )


@query
def taxonomy_roots(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.roots(views.catalogue(spark, sf)).select(_place(), "path")


@query
def taxonomy_search(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.search(views.catalogue(spark, sf), "SIZE 1").select(_place(), "path")


@query
def taxonomy_stats(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.stats(views.catalogue(spark, sf))


# Routing, ledger, statistics


@query
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select(
        "obj_key", "path", F.size("parts").alias("levels"), F.size("folders").alias("folder_levels"), "tag1", "tag2", "tag3"
    )


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return route.folder_plan(_labelled(spark, sf), views.space_nodes(spark, sf), rules.TARGET)


@query
def folder_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select(
        "level", F.array_join("folders", labels.SEPARATOR).alias("path"), "parent_token", "title", "node_token", "created"
    )


@query
def new_folders(spark: SparkSession, sf: str) -> DataFrame:
    return route.new_folder_nodes(_plan(spark, sf))


def _outcomes(spark: SparkSession, sf: str, walked: tree.Walk | None = None) -> DataFrame:
    """Pending documents through cache and answers, up to their status."""
    reads = _looked_up(spark, sf, walked)
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    answers = found.select("obj_key", F.col("path").alias("new_path"))
    sent = (F.col("read_status") == reading.OK) & F.col("cached_path").isNull()
    joined = reads.join(answers, "obj_key", "left").withColumn(
        "path", F.coalesce("cached_path", F.when(sent, F.col("new_path")))
    )
    return scratch.stage(route.copy_status(joined.drop("new_path")), scratch.new_folder(spark, "outcomes"))


def _output(spark: SparkSession, sf: str) -> str:
    """The folder that routed and annotated documents were written to."""
    routes = route.route_columns(_outcomes(spark, sf).filter(F.col("status") == route.SUCCESS))
    plan = route.folder_plan(routes, views.space_nodes(spark, sf), rules.TARGET)
    routed = route.route_documents(routes.withColumn("tag_line", route.tag_line(F.col("parts"))), plan)
    bodies = reading.attach_contents(routed, views.contents(spark, sf), how="inner")
    folder = scratch.new_folder(spark, "documents")
    tables.write_output(
        bodies.select("node_token", "obj_token", "title", "target_parent", "tag_line", "content", "tag1", "tag2", "tag3"), folder
    )
    return folder


@query
def routed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_output(spark, _output(spark, sf), tables.ROUTED).select(
        "node_token", "obj_token", "title", "target_parent", "tag1", "tag2", "tag3", F.sha2("content", 256).alias("body_hash")
    )


@query
def tag_message(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("obj_key", labels.tag_message(F.col("parts")).alias("message"))


@query
def annotated_docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_output(spark, _output(spark, sf), tables.ANNOTATED).select(
        "obj_token", "tag_line", F.sha2("annotated_content", 256).alias("annotated_hash")
    )


@query
def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    done = _outcomes(spark, sf).filter(F.col("status") == route.SUCCESS)
    new = tables.ledger_rows(done, rules.DOCUMENT_ROOT, rules.TARGET, F.expr("timestamp'2024-02-01 00:00:00'"))
    log = scratch.new_folder(spark, "ledger")
    tables.add_to_log(views.ledger(spark, sf), log, "1")
    tables.add_to_log(new, log, "2")
    after = tables.newest_entries(tables.read_log(spark, log, schemas.LEDGER))
    return after.select("node_token", "scan_root", "target_root", F.month("processed_at").alias("processed_month"))


@query
def ledger_load(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of two scan roots, loaded for one of them, for another, forced, and switched off."""
    both = views.ledger(spark, sf).unionByName(views.ledger(spark, sf, "ELSEWHERE"))
    choices = {
        "same root": tables.processed_nodes(both, rules.DOCUMENT_ROOT),
        "other root": tables.processed_nodes(both, "R1"),
        "forced": tables.processed_nodes(both, rules.DOCUMENT_ROOT, force=True),
        "off": tables.processed_nodes(both, rules.DOCUMENT_ROOT, enabled=False),
    }
    loaded = [nodes.select(F.lit(choice).alias("choice"), "node_token") for choice, nodes in choices.items()]
    return views._union(*loaded)


@query
def ledger_import(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier progress files taken over as a ledger, beside a newer entry for some of their nodes."""
    progress = views.progress(spark, sf).select(F.from_json("value", schemas.PROGRESS).alias("p")).select("p.*")
    taken = tables.ledger_from_progress(progress, rules.TARGET)
    newer = taken.filter("node_token LIKE '%7'").withColumn("processed_at", F.expr("timestamp'2024-04-01 00:00:00'"))
    after = tables.newest_entries(taken.unionByName(newer))
    return after.select("node_token", "scan_root", "target_root", F.month("processed_at").alias("processed_month"))


@query
def classify_stats(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify_stats(_outcomes(spark, sf))


@query
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    walked = _walk(spark, sf)
    return route.run_stats(
        tree.scan_stats(walked), _leaves(spark, sf, walked), _pending(spark, sf, walked), _outcomes(spark, sf, walked)
    )


@query
def end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run with a filled cache and ledger; what became of every pending document."""
    base = scratch.new_folder(spark, "run")
    settings = Settings(
        state=f"{base}/state", output=f"{base}/output", run_id="1", scan_root=rules.DOCUMENT_ROOT,
        target_token=rules.TARGET, template=rules.REQUEST_TEMPLATE,
    )
    tree_of_labels = views.labels(spark)
    known = views.cache(spark, sf, taxonomy.taxonomy_version(tree_of_labels))
    tables.add_to_log(known, f"{settings.state}/cache", "0")
    tables.add_to_log(views.ledger(spark, sf), f"{settings.state}/ledger", "0")
    nodes = views.space_nodes(spark, sf)
    infos = nodes.select("node_token", "obj_type", "obj_token")
    result = run(Inputs(nodes, views.contents(spark, sf), tree_of_labels, stub_provider, infos), settings)
    routed = result.routed.select("node_token", "target_parent", "tag_line")
    annotated = result.annotated.select("node_token", F.sha2("annotated_content", 256).alias("annotated_hash"))
    return result.outcomes.join(routed, "node_token", "left").join(annotated, "node_token", "left").select(
        "obj_key", "node_token", "read_status", F.col("cached_path").isNotNull().alias("cached"), "path", "match_tier",
        "status", "target_parent", "tag_line", "annotated_hash",
    )
