"""Contiguous shards of nearly equal bytes, from prefix sums over per-partition totals.

Documents are ordered by id, checksum and size. Only these narrow columns are sorted; the text is read once, where it
lies. Each range partition sums its own bytes and rows, the prefix sums over those totals (one row a partition) tell
where each partition begins, and a running sum inside the partition gives every document its place in the whole. The
byte line is cut at equal targets: a document belongs to the shard in which its middle byte lies, so a shard differs
from the target by less than one document at either end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgrove.llm.tables import keep, narrow

SHARDS = 8


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, size, text_crc32, shard (0 to shards - 1) and slot (its number in the shard).

    Null and empty texts have size 1 and checksum 0. Rows without an id come first. Rows that agree in id, checksum and
    size are the same to the order: which of them gets which slot is not fixed. Other columns are not read.
    """
    order = [F.asc_nulls_first(id_column), "text_crc32", "size"]
    rows = narrow(docs, id_column, text)
    rows = rows.select(id_column, text_size(F.col(text)).alias("size"), text_crc(F.col(text)).alias("text_crc32"))
    # Copies of one row may be many; a number spreads them over partitions.
    rows = rows.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    ranged = rows.repartitionByRange(*order, "tie").withColumn("part", F.spark_partition_id())
    ranged = keep(ranged, "ranged")

    every = Window.partitionBy()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    offsets = keep(offsets, "offsets")

    inside = Window.partitionBy("part").orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(
        id_column, "size", "text_crc32", "part", F.sum("size").over(inside).alias("upto"), F.count(F.lit(1)).over(inside).alias("nth")
    )
    middle = F.expr(f"(2 * (bytes_before + upto) - size) * {shards} div (2 * all_bytes)")
    placed = placed.join(offsets, "part").select(
        id_column, "size", "text_crc32", F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
    )
    placed = keep(placed, "placed")
    firsts = keep(placed.groupBy("shard").agg(F.min("row").alias("first")), "firsts")
    return placed.join(firsts, "shard").select(
        id_column, "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text") -> None:
    """Write whole rows into one folder per shard. Each row finds its shard by comparing its place in the order with the
    shards' first rows (one per shard), so texts are not shuffled; rows equal in the order stay together."""
    placed = byte_shards(docs, shards, id_column, text)
    key = F.struct(F.coalesce(id_column, F.lit(-(2**63))).alias("id"), "text_crc32", "size")
    firsts = placed.groupBy("shard").agg(F.min(key).alias("k")).orderBy("shard").collect()
    own = [F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(-(2**63))), text_crc(F.col(f"`{text}`")), text_size(F.col(f"`{text}`"))]
    shard = F.lit(firsts[0]["shard"] if firsts else 0)
    for row in firsts[1:]:
        a, b, c = row["k"]
        after = (own[0] > a) | ((own[0] == a) & ((own[1] > b) | ((own[1] == b) & (own[2] >= c))))
        shard = F.when(after, F.lit(row["shard"])).otherwise(shard)
    docs.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(path)
