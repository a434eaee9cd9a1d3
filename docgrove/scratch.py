"""Intermediate tables in the folder all executors share.

A step that is expensive, or read several times, is written once and read back. Unlike a cached
or locally checkpointed frame, such a table survives the loss of executors, and its file sizes give
the planner true statistics: it broadcasts a staged side only when it measures small enough
(`spark.sql.autoBroadcastJoinThreshold`), and shuffles it otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. There is no other: a folder of one machine is none that executors share."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/docgrove/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str) -> DataFrame:
    """Write `df` to a folder of its own and return the table read back from it."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """While tables are written within it, Arrow batches of about `most` bytes go to Python workers. By default a batch has
    10,000 rows however long, and a worker holds it several times over. A smaller bound of the session stays as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is not None and before.isdigit() and int(before) <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage_counted(df: DataFrame, folder: str, *counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Like `stage`, with aggregates taken as the rows pass by: nothing is read again for them."""
    seen = Observation()
    staged = stage(df.observe(seen, *counts), folder)
    return staged, seen.get
