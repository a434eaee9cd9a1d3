"""Label trees: load, list, search and describe.

A label tree is small by its nature, since all of it is put into every model request. `label_array` and `outline`
make one value of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove import scratch
from docgrove.functions.labels import SEPARATOR

# Fixed value, equal to the reference's: between list items in the outline.
ITEM_SEPARATOR = "、"


def _described(rows: DataFrame) -> DataFrame:
    """Add parent and leaf columns to `(ord_path, path, listed)`; layout `schemas.TAXONOMY`."""
    parts = F.split("path", SEPARATOR)
    rows = rows.select(
        "ord_path",
        "path",
        parts.alias("parts"),
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEPARATOR)).alias("parent_path"),
        F.size(parts).alias("depth"),
        "listed",
    )
    parents = rows.filter("parent_path is not null").select(F.col("parent_path").alias("path")).distinct()
    return rows.join(parents.withColumn("inner", F.lit(True)), "path", "left").select(
        "ord_path", "path", "parts", "parent_path", "depth", F.col("inner").isNull().alias("is_leaf"), "listed"
    )


def from_paths(rows: DataFrame) -> DataFrame:
    """From `(ord, path)` rows in pre-order."""
    return _described(
        rows.select(F.array(F.col("ord").cast("bigint")).alias("ord_path"), "path", F.lit(False).alias("listed"))
    )


def from_adjacency(rows: DataFrame) -> DataFrame:
    """From `(id, parent, label, ord)` rows, optionally with `listed`."""
    if "listed" not in rows.columns:
        rows = rows.withColumn("listed", F.lit(False))
    base = scratch.new_folder(rows.sparkSession, "labels")
    rows = scratch.stage(
        rows.select("id", "parent", "label", F.col("ord").cast("bigint").alias("ord"), "listed"), f"{base}/rows"
    )
    top = rows.filter("parent is null").select(
        "id", F.array("ord").alias("ord_path"), F.col("label").alias("path"), "listed"
    )

    def below(level: DataFrame) -> DataFrame:
        above = level.select(F.col("id").alias("parent"), "ord_path", "path")
        return rows.join(above, "parent").select(
            "id",
            F.concat("ord_path", F.array("ord")).alias("ord_path"),
            F.concat("path", F.lit(SEPARATOR), "label").alias("path"),
            "listed",
        )

    return _by_levels(top, below, base)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """From a file with one nested object: keys are labels, `{}` and `[]` are leaves, list items too."""
    return from_json_text(spark.read.text(path, wholetext=True))


def from_json_text(tree: DataFrame) -> DataFrame:
    """Like `from_json`, from a column `value` that holds the object.

    Each level is parsed as a map, which keeps keys in the order of the text. A variant would be parsed once, but sorts the
    keys of an object, and the order of labels decides which of several matches is the first."""

    def children(value: Column) -> Column:
        def child(label: Column, below: Column, listed: bool) -> Column:
            return F.struct(label.alias("label"), below.alias("value"), F.lit(listed).alias("listed"))

        items = F.transform(F.from_json(value, "array<string>"), lambda item: child(item, F.lit("{}"), True))
        keys = F.transform(
            F.map_entries(F.from_json(value, "map<string,string>")), lambda e: child(e["key"], e["value"], False)
        )
        return F.when(F.ltrim(value).startswith("["), items).otherwise(keys)

    def below(level: DataFrame) -> DataFrame:
        position = F.array(F.col("pos").cast("bigint"))
        return level.select("ord_path", "path", F.posexplode(children(F.col("value"))).alias("pos", "child")).select(
            F.concat("ord_path", position).alias("ord_path"),
            F.concat_ws(SEPARATOR, "path", "child.label").alias("path"),
            "child.listed",
            "child.value",
        )

    root = tree.select(
        F.array().cast("array<bigint>").alias("ord_path"), F.lit(None).cast("string").alias("path"), "value"
    )
    return _by_levels(below(root), below, scratch.new_folder(tree.sparkSession, "labels"))


def _by_levels(top: DataFrame, below: Callable[[DataFrame], DataFrame], base: str) -> DataFrame:
    """Label tree from its top level and the step to the next one; each level is a small staged table."""
    level = scratch.stage(top, f"{base}/level-0")
    levels = []
    while not level.isEmpty():
        levels.append(level.select("ord_path", "path", "listed"))
        level = scratch.stage(below(level), f"{base}/level-{len(levels)}")
    return _described(reduce(DataFrame.unionByName, levels or [level.select("ord_path", "path", "listed")]))


def label_array(taxonomy: DataFrame) -> Column:
    """All paths in pre-order as one array value, a scalar subquery."""
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ord_path", "path"))), lambda row: row["path"])
    return taxonomy.agg(in_order.alias("paths")).scalar()


def taxonomy_version(taxonomy: DataFrame) -> Column:
    """Fingerprint of the paths and their order: part of the cache key."""
    return F.sha2(F.array_join(label_array(taxonomy), "\n"), 256)


def roots(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter("depth = 1").orderBy("ord_path")


def search(taxonomy: DataFrame, keyword: str) -> DataFrame:
    """Paths that contain the keyword, in any case."""
    return taxonomy.filter(F.lower("path").contains(F.lower(F.lit(keyword))))


def stats(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.agg(
        F.count(F.lit(1)).alias("n_paths"),
        F.count_if(F.col("depth") == 1).alias("n_roots"),
        F.count_if("is_leaf").alias("n_leaves"),
        F.max("depth").alias("max_depth"),
    )


def outline_lines(taxonomy: DataFrame) -> DataFrame:
    """Indented outline, a row `(ord_path, line)` per label; the items of a list share one line.

    A root, and a label with further labels that are no list items, ends in a colon.
    """
    label = F.element_at("parts", -1)
    holders = (
        taxonomy.filter("not listed and parent_path is not null")
        .select(F.col("parent_path").alias("path"))
        .distinct()
        .withColumn("holds", F.lit(True))
    )
    single = taxonomy.filter("not listed").join(holders, "path", "left").select(
        "ord_path",
        F.concat(
            F.repeat(F.lit("  "), F.col("depth") - 1),
            F.lit("- "),
            label,
            F.when((F.col("depth") == 1) | F.col("holds").isNotNull(), F.lit(":")).otherwise(F.lit("")),
        ).alias("line"),
    )
    items = (
        taxonomy.filter("listed")
        .groupBy("parent_path", "depth")
        .agg(F.sort_array(F.collect_list(F.struct("ord_path", label.alias("label")))).alias("items"))
        .select(
            F.col("items")[0]["ord_path"].alias("ord_path"),
            F.concat(
                F.repeat(F.lit("  "), F.col("depth")),
                F.array_join(F.transform("items", lambda i: i["label"]), ITEM_SEPARATOR),
            ).alias("line"),
        )
    )
    return single.unionByName(items)


def outline(taxonomy: DataFrame) -> Column:
    """The outline as one text, a scalar subquery, for the request template."""
    lines = F.sort_array(F.collect_list(F.struct("ord_path", "line")))
    text = F.array_join(F.transform(lines, lambda row: row["line"]), "\n")
    return outline_lines(taxonomy).agg(text.alias("outline")).scalar()
