"""Folders for classified documents, the routed documents, and run statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove import scratch
from docgrove.functions.labels import FOLDER_LEVELS, folder_parts, path_parts, tag_message
from docgrove.functions.text import annotated_body, strip
from docgrove.operators.tree import TOP, child_map, one_row

SUCCESS, FAILED, EMPTY = "success", "failed", "empty"


def route_columns(docs: DataFrame) -> DataFrame:
    """Add to documents with a `path`: all labels, the folder labels, and these as `tag1` to `tag3`."""
    parted = docs.withColumn("parts", path_parts(F.col("path")))
    routed = parted.withColumn("folders", folder_parts(F.col("parts")))
    tags = {f"tag{level + 1}": F.get("folders", F.lit(level)) for level in range(FOLDER_LEVELS)}
    return routed.withColumns(tags)


def new_token(parent: Column, title: Column) -> Column:
    """Token of a folder to create: the same whenever the plan is made again."""
    return F.sha2(F.concat_ws("/", parent, title), 256)


def folder_plan(routes: DataFrame, nodes: DataFrame, target_root: str | None, base: str | None = None) -> DataFrame:
    """Every folder the routes need: `(level, folders, parent_token, title, node_token, created)`.

    A child of that title is taken, of whatever type; where there is none, a folder is to be created.
    Distinct label chains and the children with such titles are staged: `nodes` is read once, and
    both stay as small as the label tree. They and the plan are written below `base`.
    """
    base = base or scratch.new_folder(routes.sparkSession, "folders")
    upper = F.transform(F.sequence(F.lit(1), F.size("folders")), lambda n: F.slice("folders", 1, n))
    chains = scratch.stage(
        routes.filter("size(folders) > 0")
        .select("folders")
        .distinct()
        .select(F.explode(upper).alias("folders"))
        .distinct(),
        f"{base}/chains",
    )
    names = chains.select(F.element_at("folders", -1).alias("title")).distinct()
    known = scratch.stage(child_map(nodes.join(names, "title", "left_semi")), f"{base}/known").select(
        F.col("parent_key").alias("parent_token"), "title", F.col("node_token").alias("existing")
    )
    top = F.lit(target_root or TOP)
    levels: list[DataFrame] = []
    for level in range(1, FOLDER_LEVELS + 1):
        wanted = chains.filter(F.size("folders") == level).withColumn("title", F.element_at("folders", -1))
        if levels:
            above = levels[-1].select(F.col("folders").alias("above"), F.col("node_token").alias("parent_token"))
            wanted = wanted.join(above, F.slice("folders", 1, level - 1) == F.col("above"))
        else:
            wanted = wanted.withColumn("parent_token", top)
        levels.append(
            wanted.join(known, ["parent_token", "title"], "left").select(
                F.lit(level).alias("level"),
                "folders",
                "parent_token",
                "title",
                F.coalesce("existing", new_token(F.col("parent_token"), F.col("title"))).alias("node_token"),
                F.col("existing").isNull().alias("created"),
            )
        )
    return scratch.stage(reduce(DataFrame.unionByName, levels), f"{base}/plan")


def new_folder_nodes(plan: DataFrame) -> DataFrame:
    """Node rows of the folders to create."""
    return plan.filter("created").select(
        "node_token",
        F.nullif("parent_token", F.lit(TOP)).alias("parent_node_token"),
        "title",
        F.lit("docx").alias("obj_type"),
        F.lit("origin").alias("node_type"),
    )


def copy_status(docs: DataFrame) -> DataFrame:
    """Add `status`: empty without a body, failed without a label or a source object, else success."""
    copyable = (F.coalesce("obj_token", F.lit("")) != "") & (F.coalesce("obj_type", F.lit("")) != "")
    return docs.withColumn(
        "status",
        F.when(F.col("read_status") != "ok", F.lit(EMPTY))
        .when(F.col("path").isNotNull() & copyable, F.lit(SUCCESS))
        .otherwise(F.lit(FAILED)),
    )


def route_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Successful documents with the folder they go to as `target_parent`."""
    targets = plan.select("folders", F.col("node_token").alias("target_parent"))
    return docs.filter(F.col("status") == SUCCESS).join(targets, "folders")


def tag_line(parts: Column) -> Column:
    """The tag message as it is put before the body."""
    return strip(tag_message(parts))


def annotate(docs: DataFrame) -> DataFrame:
    """Add `annotated_content`, the body under its tag line; the source stays as it is. Without a tag line
    there is no annotation."""
    return docs.withColumn("annotated_content", annotated_body(F.col("tag_line"), F.col("content")))


def outcome_counts() -> list[Column]:
    """Aggregates over outcomes with a `status`: documents that succeeded, failed, and had no body."""
    return [F.count_if(F.col("status") == status).alias(status) for status in (SUCCESS, FAILED, EMPTY)]


def run_stats(scan: DataFrame, found: DataFrame, pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of run statistics. `scan` is a `scan_stats` row; `found` and `pending` are the leaf documents
    after the limit and after dropping processed ones; `outcomes` has a `status` per document."""
    return run_statistics(one_row(
        scan.select("non_leaf_docx_skipped"),
        found.agg(F.count(F.lit(1)).alias("found")),
        pending.agg(F.count(F.lit(1)).alias("pending")),
        outcomes.agg(*outcome_counts()),
    ))


def run_statistics(counts: DataFrame) -> DataFrame:
    """Run statistics from one row of the counts they are made of, however these were taken."""
    tried = F.col("success") + F.col("failed")
    return counts.select(
        "found",
        "non_leaf_docx_skipped",
        "success",
        "failed",
        (F.col("found") - F.col("pending") + F.col("empty")).alias("skipped"),
        "empty",
        F.round(F.try_divide(F.col("success") * 100.0, tried), 1).alias("success_rate"),
    )
