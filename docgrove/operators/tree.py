"""The node hierarchy: walks in breadth-first order, leaf documents, lookups by title.

Only nodes with children are expanded, each once, and every other column of a walk follows from the
parent's place. So the rounds of a walk run over the links between inner nodes alone, a narrow and small
part of the table; the whole table is read once, in the join that attaches places to nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrove import scratch

# Queue order of a walk: by the place of the parent among all expanded nodes, then by position under it.
BFS_ORDER = ["parent_place", "ord", "node_token"]

#: Limits up to which the first rows are sought by one task; beyond, rows are numbered where they are sorted.
SMALL_LIMIT = 10_000

# Stands for "no parent": top-level nodes of a space.
TOP = ""


@dataclass(frozen=True)
class Walk:
    """`rows`: reached nodes with `depth` and `parent_place`, the number of their parent in queue order. `expanded`:
    `(parent_key, depth, place)` of the nodes whose children were listed, numbered in queue order from the start, which is 0."""

    rows: DataFrame
    expanded: DataFrame


def parent_key() -> Column:
    return F.coalesce("parent_node_token", F.lit(TOP))


def in_space(nodes: DataFrame, space_id: str | None) -> DataFrame:
    return nodes if space_id is None else nodes.filter(F.col("space_id") == space_id)


def walk(nodes: DataFrame, root: str | None = None, space_id: str | None = None) -> Walk:
    """All nodes below `root`, or the whole space without one. The root itself is not among them
    (unless a node below it lists it again). `space_id` names the space if `nodes` holds several.

    A node that several parents list appears once for each of them, and is expanded at its first place
    in queue order. Expanded nodes are never expanded again, so cycles end.

    A node with one parent follows pointers that double in length, up to its fixed point: the start, or a node with several
    parents. So a chain of any depth takes as many rounds as the logarithm of its length. What is not below a fixed point
    never comes to rest: it hangs below a cycle or a parent that is not there, and is not reached. Fixed points
    take the first of the places their parents give them, round by round; rounds go by how many of them lie below
    each other, not by depth.
    """
    spark = nodes.sparkSession
    nodes = in_space(nodes, space_id)
    base = scratch.new_folder(spark, "walk")
    start = root or TOP
    links = (
        nodes.filter("has_child and node_token <> ''")
        .filter(F.col("node_token") != start)
        .groupBy("node_token", parent_key().alias("parent_key"))
        .agg(F.min(F.col("ord").cast("bigint")).alias("ord"))
    )
    links = links.withColumn("parents", F.count(F.lit(1)).over(Window.partitionBy("node_token")))
    links, seen = scratch.stage_counted(links, f"{base}/links", F.count_if(F.col("parents") > 1).alias("several"))
    begin = spark.range(0, 1, 1, 1).select(
        F.lit(start).alias("parent_key"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("ord_path")
    )
    several = links.filter("parents > 1")
    pointers = _to_fixed_points(links.filter("parents = 1"), several.select("node_token").distinct(), start, base)
    if seen["several"]:
        fixed = _fixed_places(several, pointers, begin, base)
        expanded = fixed.unionByName(_below(pointers, fixed.withColumnRenamed("parent_key", "up"), "node_token"))
    else:
        expanded = begin.unionByName(pointers.filter(F.col("up") == start).select(F.col("node_token").alias("parent_key"), "depth", "ord_path"))
    # Paths stand with inner nodes only, and only until these are numbered.
    numbered = number_in_order(expanded, "place", ["depth", "ord_path", "parent_key"], f"{base}/in-order")
    expanded = numbered.select("parent_key", "depth", "place")
    return Walk(_placed(nodes, expanded), expanded)


def number_in_order(rows: DataFrame, name: str, order: list[str], folder: str) -> DataFrame:
    """`rows` with their number in this order, from 0: sorted in ranges, and numbered within each range from the total of the
    ranges before. No task has more than a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id())
    ranged = scratch.stage(ranged, folder)
    totals = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("total"))
    before = F.sum("total").over(Window.orderBy("range")) - F.col("total")  # a row for each range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    numbered = ranged.withColumn("within", within).join(totals.select("range", before.alias("before")), "range")
    return numbered.select(*rows.columns, (F.col("before") + F.col("within")).alias(name))


def _below(steps: DataFrame, places: DataFrame, node: str) -> DataFrame:
    """`(parent_key, depth, ord_path)` of `node`, which lies `depth` and `ord_path` below a place `up`."""
    above = places.select("up", F.col("depth").alias("depth_above"), F.col("ord_path").alias("path_above"))
    return steps.join(above, "up").select(
        F.col(node).alias("parent_key"),
        (F.col("depth_above") + F.col("depth")).alias("depth"),
        F.concat("path_above", "ord_path").alias("ord_path"),
    )


def _to_fixed_points(single: DataFrame, several: DataFrame, start: str, base: str) -> DataFrame:
    """`(node_token, up, depth, ord_path)` of nodes with one parent: the fixed point above them and how far it is.

    Those that have arrived are written once and not moved again; the others jump to where the node they point at points.
    Each round halves the distance left, and at least one arrives in it, unless the rest goes round in cycles."""
    spark = single.sparkSession
    state = single.select("node_token", F.col("parent_key").alias("up"), F.lit(1).alias("depth"), F.array("ord").alias("ord_path"))
    ends = several.select(F.col("node_token").alias("up")).unionByName(spark.range(0, 1, 1, 1).select(F.lit(start).alias("up")))
    state = state.join(ends.withColumn("end", F.lit(True)), "up", "left")
    columns = ["node_token", "up", "depth", "ord_path"]
    folders: list[str] = []
    left = None
    while True:
        folders.append(f"{base}/pointers-{len(folders)}")
        state = state.select(*columns, F.col("end").isNotNull().alias("end"))
        state, seen = scratch.stage_counted(state, folders[-1], F.count_if(~F.col("end")).alias("waiting"))
        # Every node arrives in one round, and is in no later one.
        arrived = spark.read.schema(state.schema).parquet(*folders).filter("end")
        if seen["waiting"] in (0, left):
            return arrived.select(columns)
        waiting, left = state.filter("not end"), seen["waiting"]
        jumps = arrived.unionByName(waiting).select(
            F.col("node_token").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("ord_path").alias("path2"),
            F.when(F.col("end"), True).alias("end2"),
        )
        # A node whose pointer leads to no node has a parent that is not there: the inner join drops it.
        state = waiting.join(jumps, "up").select(
            "node_token", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"),
            F.concat("path2", "ord_path").alias("ord_path"), F.col("end2").alias("end"),
        )


def _fixed_places(links: DataFrame, pointers: DataFrame, begin: DataFrame, base: str) -> DataFrame:
    """Places of the start and of the nodes with several parents, the first in queue order. links: from these to all
    their parents."""
    steps = links.join(pointers.withColumnRenamed("node_token", "parent_key"), "parent_key", "left").select(
        "node_token",
        F.coalesce("up", "parent_key").alias("up"),
        (F.coalesce("depth", F.lit(0)) + 1).alias("depth"),
        F.concat(F.coalesce("ord_path", F.array().cast("array<bigint>")), F.array("ord")).alias("ord_path"),
    )
    steps = scratch.stage(steps, f"{base}/steps")
    places, number = begin, 0
    while True:
        reached = begin.unionByName(_below(steps, places.withColumnRenamed("parent_key", "up"), "node_token"))
        first = reached.groupBy("parent_key").agg(F.min(F.struct("depth", "ord_path")).alias("place"))
        number += 1
        after = scratch.stage(first.select("parent_key", "place.*"), f"{base}/places-{number}")
        if after.exceptAll(places).isEmpty():
            return after
        places = after


def _placed(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes under expanded parents. A parent that holds much of the table makes one large key on the
    left and a single row on the right: adaptive execution splits such a partition."""
    parents = expanded.select("parent_key", (F.col("depth") + 1).alias("depth"), F.col("place").alias("parent_place"))
    return (
        nodes.filter("node_token <> ''")
        .withColumn("parent_key", parent_key())
        .join(parents, "parent_key")
        .select(*nodes.columns, "depth", "parent_place")
    )


def leaf_documents(rows: DataFrame) -> DataFrame:
    """Documents without children; inner documents are folders or index pages."""
    return rows.filter((F.col("obj_type") == "docx") & ~F.coalesce("has_child", F.lit(False)))


def row_counts() -> list[Column]:
    """Aggregates over the rows of a walk: documents found, inner documents skipped, nodes reached."""
    is_docx = F.col("obj_type") == "docx"
    has_child = F.coalesce("has_child", F.lit(False))
    return [
        F.count_if(is_docx & ~has_child).alias("documents_found"),
        F.count_if(is_docx & has_child).alias("non_leaf_docx_skipped"),
        F.count(F.lit(1)).alias("nodes_reached"),
    ]


def scan_stats(walked: Walk) -> DataFrame:
    """One row: documents found, inner documents skipped, nodes reached, nodes expanded."""
    expanded = walked.expanded.agg(F.count(F.lit(1)).alias("nodes_expanded"))
    return one_row(walked.rows.agg(*row_counts()), expanded)


def one_row(*counts: DataFrame) -> DataFrame:
    """Put single-row tables of counts side by side without a join."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def first_documents(leaves: DataFrame, limit: int = 0) -> DataFrame:
    """The first documents in queue order; all of them for 0. Applies before processed ones are dropped."""
    if not limit:
        return leaves
    if limit <= SMALL_LIMIT:
        return leaves.orderBy(*BFS_ORDER).limit(limit)
    folder = scratch.new_folder(leaves.sparkSession, "first")
    return number_in_order(leaves, "number", BFS_ORDER, folder).filter(F.col("number") < limit).drop("number")


def find_by_title(nodes: DataFrame, title: str) -> DataFrame:
    """One row `(node_token)`: the first top-level node with that title, null if there is none."""
    return nodes.filter((parent_key() == TOP) & (F.col("title") == title)).agg(
        F.min_by("node_token", F.struct("ord", "node_token")).alias("node_token")
    )


def _first_titled(title: str) -> Column:
    """Aggregate over top-level nodes: the first with that title, null if there is none."""
    named = F.col("title") == title
    return F.nullif(F.min_by(F.when(named, F.col("node_token")), F.when(named, F.struct("ord", "node_token"))), F.lit(""))


def scan_root_choice(token: str | None = None, name: str | None = None) -> Column:
    """Aggregate over top-level nodes: the node to scan, given or found by name."""
    return F.lit(token) if token else _first_titled(name) if name else F.lit(None).cast("string")


def target_root_choice(
    token: str | None = None, name: str | None = None, fallback: str | None = None, token_prefix: str | None = None
) -> Column:
    """Aggregate over top-level nodes: the node that gets the folders, given, or found by name, or the fallback.
    The fallback is tried as a name first unless it begins with `token_prefix`."""
    if token:
        return F.lit(token)
    names = [name] if name else []
    if fallback and not (token_prefix and fallback.startswith(token_prefix)):
        names.append(fallback)
    return F.coalesce(*[_first_titled(n) for n in names], F.lit(fallback or None).cast("string"))


def choose(nodes: DataFrame, **choices: Column) -> DataFrame:
    """One row with a column per choice, from one pass over the top-level nodes."""
    return nodes.filter(parent_key() == TOP).agg(*[c.alias(name) for name, c in choices.items()])


def scan_root(nodes: DataFrame, token: str | None = None, name: str | None = None) -> str:
    """Token of the node to scan. It is an error if there is none."""
    found = token or choose(nodes, root=scan_root_choice(token, name)).first()[0]
    if not found:
        raise ValueError(f"no node to scan: token {token!r}, name {name!r}")
    return found


def target_root(
    nodes: DataFrame,
    token: str | None = None,
    name: str | None = None,
    fallback: str | None = None,
    token_prefix: str | None = None,
) -> str | None:
    """Token of the node that gets the folders. None means the top of the space."""
    return token or choose(nodes, root=target_root_choice(token, name, fallback, token_prefix)).first()[0]


def child_map(nodes: DataFrame) -> DataFrame:
    """`(parent_key, title, node_token)`: the direct children of every parent by title; of several with
    the same title the last counts. Filter `nodes` for the children of one parent."""
    return titles_by_parent(nodes).select("parent_key", "title", "node_token")


def titles_by_parent(nodes: DataFrame) -> DataFrame:
    """`child_map` with the number of children that carry the title."""
    return (
        nodes.filter("title <> '' and node_token <> ''")
        .groupBy(parent_key().alias("parent_key"), "title")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.max_by("node_token", F.struct("ord", "node_token")).alias("node_token"),
        )
    )


def duplicate_titles(nodes: DataFrame) -> DataFrame:
    """Titles that occur more than once under a parent."""
    return titles_by_parent(nodes).filter("occurrences > 1")


def title_counts(nodes: DataFrame) -> DataFrame:
    """Number of different titles under each parent. Counted title by title first, so that a parent with
    very many children is no single large group."""
    return titles_by_parent(nodes).groupBy("parent_key").agg(F.count(F.lit(1)).alias("total_count"))


def check_titles(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each different wanted `(parent_key, title)`: is it taken, by which node, and how often."""
    return (
        wanted.select("parent_key", "title")
        .distinct()
        .join(titles_by_parent(nodes), ["parent_key", "title"], "left")
        .select(
            "parent_key",
            "title",
            F.col("node_token").isNotNull().alias("is_duplicate"),
            "node_token",
            F.coalesce("occurrences", F.lit(0).cast("bigint")).alias("occurrences"),
        )
    )
