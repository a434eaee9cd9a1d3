"""Small helpers the operators share: staged tables, free column names, numbers of partitions, whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove.scratch import new_folder, stage


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read back: later steps neither repeat it nor depend on executors."""
    return stage(df, new_folder(df.sparkSession, f"llm/{name}"))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """Only the id (as long) and the named columns; whatever else `df` has can then clash with nothing."""
    return df.select(F.col(f"`{id_column}`").cast("long").alias(id_column), *[F.col(f"`{c}`") for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(df: DataFrame) -> None:
    """Delete a kept table that nothing reads any more; what was made of it must have been written."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
