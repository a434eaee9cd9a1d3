"""Connected components of a table of links, by alternating large and small stars.

Each step is two aggregates and two joins on narrow rows, staged in the shared folder; a hub is pre-aggregated by
the minimum and, as one side of a join, split by adaptive execution. Nothing of the graph reaches the driver but
two sums that tell whether a step has changed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.tables import forget, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links between keys of any ordered type -> one row (node, root) for each linked node that is not itself
    the least of its component; root is that least node. Links of a node to itself and repeated ones are harmless;
    an empty table gives an empty one."""
    edges = keep(links.select("u", "v").filter("u <> v"), "links")
    before = _state(edges)
    while before[0]:
        last, edges = edges, keep(_small_star(_large_star(edges)), "stars")
        forget(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
