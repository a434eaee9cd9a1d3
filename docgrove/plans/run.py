"""One run over a snapshot: scan, read, classify, route, and remember what was done.

Every step ends in a table in the run's folder, which the next steps read. The model is called once per
document that has a body and no cached label; its answers are on disk before anything depends on
them. Bodies are joined in twice: to the requests, and to the routed documents; all else is narrow.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.operators import classify, matching, reading, route, tree
from docgrove.scratch import batch_bytes, stage, stage_counted
from docgrove.sources import tables, taxonomy


@dataclass(frozen=True)
class Inputs:
    """`content_parts` says that `contents` was laid out in so many parts (`tables.save_content_parts`): each commit then
    reads the files of its own parts only."""

    nodes: DataFrame
    contents: DataFrame
    taxonomy: DataFrame
    provider: classify.Provider
    infos: DataFrame | None = None
    content_parts: int = 0


@dataclass(frozen=True)
class Settings:
    """Where state and results go, and what the run covers. `state` keeps cache, ledger, leaf sets and node
    snapshot. `output` gets a folder per `run_id`; a run that is repeated writes its tables anew, and readers see them once all
    are there. `commits` is the number of parts in which answers are made and cached: a run that breaks off repeats the
    calls of one part at most. After `compact_after` runs the logs of cache and ledger are merged into one part."""

    state: str
    output: str
    run_id: str
    space_id: str = "space"
    scan_root: str | None = None
    scan_name: str | None = None
    target_token: str | None = None
    target_name: str | None = None
    target_fallback: str | None = None
    template: str = "{outline}\n\n{text}"
    max_documents: int = 0
    commits: int = 1
    use_cache: bool = True
    use_ledger: bool = True
    force: bool = False
    reuse_scan: bool = False
    add_tags: bool = True
    compact_after: int = 20


@dataclass(frozen=True)
class Result:
    scan_root: str
    target_root: str | None
    leaves: DataFrame
    outcomes: DataFrame
    folders: DataFrame
    routed: DataFrame
    annotated: DataFrame
    stats: DataFrame
    classify_stats: DataFrame


def run(inputs: Inputs, settings: Settings) -> Result:
    spark = inputs.nodes.sparkSession
    if "space_id" in inputs.nodes.columns:
        inputs = replace(inputs, nodes=tree.in_space(inputs.nodes, settings.space_id).drop("space_id"))
    folder = f"{settings.output}/run={settings.run_id}"
    scan_root = tree.scan_root(inputs.nodes, settings.scan_root, settings.scan_name)
    target_root = tree.target_root(
        inputs.nodes, settings.target_token, settings.target_name, settings.target_fallback
    )

    labels = stage(inputs.taxonomy, f"{folder}/labels")
    index = stage(matching.label_index(labels), f"{folder}/label_index")
    # Fingerprint and outline of the label tree: two small texts, the same for all documents.
    version, outline = spark.range(0, 1, 1, 1).select(taxonomy.taxonomy_version(labels), taxonomy.outline(labels)).first()

    number = F.count(F.lit(1))
    leaves, counts = _scan(spark, inputs.nodes, settings, scan_root, folder)
    found = leaves
    if settings.max_documents:
        first = tree.first_documents(leaves, settings.max_documents)
        found, seen = stage_counted(first, f"{folder}/found", number.alias("found"))
        counts |= seen

    # A repeated run does its documents again, since it replaces its output.
    ledger = tables.read_log(spark, f"{settings.state}/ledger", schemas.LEDGER, without_run=settings.run_id)
    done_before = tables.processed_nodes(ledger, scan_root, settings.use_ledger, settings.force)
    pending, seen = stage_counted(reading.pending(found, done_before), f"{folder}/pending", number.alias("pending"))
    counts |= seen

    docs = reading.dedupe_objects(pending).select("obj_key", "node_token", "title", "obj_type", "obj_token")
    status = reading.read_status(docs, inputs.contents, inputs.infos)
    reads = _with_cache(spark, settings, status, version, folder)

    repeated = reading.repeats(reads)
    labelled = _answers(inputs, settings, reads, index, version, outline, repeated, folder)
    outcomes, seen = _outcomes(reads, labelled, folder)
    counts |= seen

    routes = route.route_columns(outcomes.filter(F.col("status") == route.SUCCESS))
    folders = route.folder_plan(routes, inputs.nodes, target_root, f"{folder}/folders")
    line = route.tag_line(F.col("parts")) if settings.add_tags else F.lit(None).cast("string")
    routed = route.route_documents(routes.withColumn("tag_line", line), folders)
    bodies = reading.attach_contents(routed, inputs.contents, how="inner", repeated=repeated)
    bodies = bodies.select("node_token", "obj_token", "title", "target_parent", "tag_line", "content", "tag1", "tag2", "tag3")
    tables.write_output(bodies, f"{folder}/documents")

    _remember(settings, outcomes, scan_root, target_root)
    return Result(
        scan_root,
        target_root,
        leaves,
        outcomes,
        folders,
        route.annotate(tables.read_output(spark, f"{folder}/documents", tables.ROUTED)),
        tables.read_output(spark, f"{folder}/documents", tables.ANNOTATED),
        route.run_statistics(_row(spark, counts, "found", "pending", "non_leaf_docx_skipped", "success", "failed", "empty")),
        _row(spark, {k.removeprefix("model_"): n for k, n in counts.items() if k.startswith("model_")}, "total", "ok", "failed", "cached", "empty"),
    )


def _row(spark, counts, *names):
    return spark.range(0, 1, 1, 1).select(*[F.lit(counts[n]).cast("bigint").alias(n) for n in names])


def _scan(spark, nodes, settings, scan_root, folder):
    """Leaf documents and counts of the scan, from an earlier finished scan if that may be reused."""
    sets = f"{settings.state}/leaf_sets"
    if settings.reuse_scan:
        stored = tables.load_leaf_set(spark, sets, settings.space_id, scan_root)
        if stored is not None:
            return stored, {"found": stored.count(), "non_leaf_docx_skipped": 0}
    rows, counts = stage_counted(tree.walk(nodes, scan_root).rows, f"{folder}/walked", *tree.row_counts())
    tables.save_leaf_set(tree.leaf_documents(rows), sets, settings.space_id, scan_root)
    tables.upsert_snapshot(tables.snapshot_rows(rows), f"{settings.state}/nodes")
    return tree.leaf_documents(rows), counts | {"found": counts["documents_found"]}


def _with_cache(spark, settings, status, version, folder):
    if not settings.use_cache:
        return stage(status.withColumn("cached_path", F.lit(None).cast("string")), f"{folder}/reads")
    log = tables.read_log(spark, f"{settings.state}/cache", schemas.CACHE)
    cache = tables.latest(log, "obj_token", F.col("updated_at"))
    return stage(classify.cache_lookup(status, cache, version), f"{folder}/reads")


def commit_parts(inputs: Inputs, settings: Settings) -> list[list[int]]:
    """The parts of documents each commit takes up: stored parts of the bodies where there are any."""
    parts = inputs.content_parts or settings.commits
    return [list(range(n, parts, settings.commits)) for n in range(min(parts, settings.commits))]


def commit_bodies(inputs: Inputs, misses: DataFrame, parts: list[int], of: int, repeated: bool) -> DataFrame:
    """The documents of one commit with their bodies: `parts` out of `of`. A document belongs to the part of the response it takes; in contents
    laid out by that, the files of other parts are not read."""
    contents = inputs.contents
    if inputs.content_parts:
        contents = contents.filter(F.col(tables.PART).isin(parts)).drop(tables.PART)
    number = tables.content_part(F.col("response_id"), of)
    return reading.attach_contents(misses.filter(number.isin(parts)), contents, how="inner", repeated=repeated)


def _answers(inputs, settings, reads, index, version, outline, repeated, folder):
    misses = reads.filter((F.col("read_status") == reading.OK) & F.col("cached_path").isNull())
    done = []
    for number, parts in enumerate(commit_parts(inputs, settings)):
        bodies = commit_bodies(inputs, misses, parts, inputs.content_parts or settings.commits, repeated)
        requests = classify.model_requests(bodies)
        asked = classify.call_model(requests, inputs.provider, settings.template, outline=outline)
        with batch_bytes(misses.sparkSession, classify.BATCH_BYTES):
            answers = stage(asked, f"{folder}/answers/part={number}")
        labelled = stage(classify.label_answers(answers, index), f"{folder}/labelled/part={number}")
        done.append(labelled)
        if settings.use_cache:
            hashed = labelled.join(reads.select("obj_key", "content_hash"), "obj_key")
            tables.add_to_log(classify.cache_rows(hashed, version), f"{settings.state}/cache", settings.run_id)
    if settings.use_cache:
        tables.compact_cache(misses.sparkSession, f"{settings.state}/cache", settings.compact_after)
    return reduce(DataFrame.unionByName, done)


def _outcomes(reads, labelled, folder):
    new = labelled.select("obj_key", "error", F.col("path").alias("new_path"), "match_tier")
    joined = reads.join(new, "obj_key", "left").withColumn("path", F.coalesce("cached_path", "new_path"))
    made = [c.alias(f"model_{n}") for c, n in zip(classify.classification_counts(), ("total", "ok", "failed", "cached", "empty"))]
    return stage_counted(route.copy_status(joined.drop("new_path")), f"{folder}/outcomes", *route.outcome_counts(), *made)


def _remember(settings, outcomes, scan_root, target_root):
    """Last of all, so that a run that fails before is simply repeated: the ledger of routed documents.
    Empty and failed ones are tried again in the next run."""
    if settings.use_ledger:
        done = tables.ledger_rows(outcomes.filter(F.col("status") == route.SUCCESS), scan_root, target_root)
        tables.add_to_log(done, f"{settings.state}/ledger", settings.run_id, replace=True)
        tables.compact_ledger(done.sparkSession, f"{settings.state}/ledger", settings.compact_after)
