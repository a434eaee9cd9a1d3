"""State kept between runs as parquet: logs, versioned tables, leaf sets, run outputs.

Parquet has no merge. The cache and the ledger are logs: a run adds a part with its new rows only, and
readers take the newest row of a key. From time to time a log is merged into a base part with one row per key, the next
version of the base; parts added later are kept by the base they came after. The node snapshot lies in hash buckets, of which
a scan writes those with changes as their next version; leaf sets are written as a next version as a whole. A version counts once a row
in the table `finished` beside it names it, which is written after all of it. Either way nothing is overwritten
while it is read, and an interrupted write leaves the earlier state in place.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.scratch import stage
from docgrove.functions.labels import path_from_tags
from docgrove.functions.text import annotated_body

#: Column of the part in laid-out contents, folder of a log's merged rows, and the two tables of an output.
PART = "content_part"
BASE = "base"
BUCKET, SNAPSHOT_BUCKETS = "bucket", 64
ROUTED, ANNOTATED = "routed", "annotated"


def _part(path: str, **keys: str) -> str:
    """Partition folder for these values; Spark reads `%2F` and the like back as the characters."""
    escaped = {k: re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):02X}" if m[0].isascii() else m[0], v) for k, v in keys.items()}
    return "/".join([path, *[f"{k}={v}" for k, v in escaped.items()]])


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at `path`, or None if nothing was written there."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def add_to_log(df: DataFrame, path: str, run_id: str, replace: bool = False) -> None:
    """Add rows to the part of a run, or replace that part; what the base has of a replaced run counts no more."""
    spark = df.sparkSession
    base = current_version(spark, f"{path}/{BASE}")
    df.write.mode("overwrite" if replace else "append").parquet(_part(_added(path, base), run=run_id))
    if replace and base:
        spark.range(0, 1, 1, 1).select(F.lit(run_id).alias("run")).write.mode("append").parquet(_replaced(path, base))


def _added(path: str, base: int) -> str:
    """Where parts go that are newer than this base."""
    return f"{path}/since={base:06d}"


def _replaced(path: str, base: int) -> str:
    return f"{path}/replaced/{base:06d}"


def _log_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log with the run they come from: the newest base, and the parts added since. Runs that were replaced
    since stand in the base no more."""
    base = current_version(spark, f"{path}/{BASE}")
    schema = f"{schema}, run STRING"
    found = []
    if base:
        found.append(spark.read.schema(schema).parquet(f"{path}/{BASE}/version={base:06d}"))
    parts = _read(spark, _added(path, base), schema)
    if parts is not None:
        found.append(parts)
    replaced = _read(spark, _replaced(path, base), "run STRING")
    if base and replaced is not None:
        found[0] = found[0].join(replaced.distinct(), "run", "left_anti").select(found[0].columns)
    if not found:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def read_log(spark: SparkSession, path: str, schema: str, without_run: str | None = None) -> DataFrame:
    """All rows of a log, without those of one run if named."""
    rows = _log_rows(spark, path, schema)
    return (rows.filter(F.col("run") != without_run) if without_run else rows).drop("run")


def added_parts(spark: SparkSession, path: str) -> int:
    """How many runs have added to a log since its newest base. Reads names of folders only."""
    added = _read(spark, _added(path, current_version(spark, f"{path}/{BASE}")))
    return 0 if added is None else added.select("run").distinct().count()


def compact_log(spark: SparkSession, path: str, schema: str, keys: list[str], newest: str) -> int:
    """Merge a log into a new base with the newest row of each key. The base counts once its mark is written, and parts added
    from then on go to a folder of their own: whatever breaks off, readers see the rows from before or from after, which
    say the same. Not for use while a run is adding to the log."""
    rows = _log_rows(spark, path, schema)
    others = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    kept = rows.groupBy(*keys).agg(F.max_by(others, F.struct(newest, "run")).alias("row")).select(*keys, "row.*")
    return write_next(kept.select(rows.columns), f"{path}/{BASE}")


def compact_cache(spark: SparkSession, path: str, after: int) -> None:
    """Merge the cache's log if at least `after` runs have added to it; 0 never does."""
    if after and added_parts(spark, path) >= after:
        compact_log(spark, path, schemas.CACHE, ["obj_token"], "updated_at")


def compact_ledger(spark: SparkSession, path: str, after: int) -> None:
    if after and added_parts(spark, path) >= after:
        compact_log(spark, path, schemas.LEDGER, ["node_token", "scan_root"], "processed_at")


def latest(rows: DataFrame, key: str, newest: Column) -> DataFrame:
    """One row per key, the one that is greatest in `newest`. Rows meet in partial aggregates, so a key that
    is repeated very often does not fill one task."""
    others = F.struct(*[F.col(c) for c in rows.columns if c != key])
    newest_row = rows.groupBy(key).agg(F.max_by(others, newest).alias("row"))
    return newest_row.select(key, "row.*").select(*rows.columns)


def current_version(spark: SparkSession, path: str) -> int:
    """Newest finished version, 0 if there is none. Reads the one-row marks only, no version."""
    marks = _read(spark, f"{path}/finished", "version INT")
    return 0 if marks is None else marks.agg(F.max("version")).first()[0] or 0


def read_current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    version = current_version(spark, path)
    if version == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version:06d}")


def write_next(df: DataFrame, path: str) -> int:
    """Write the next version and then its mark; what an interrupted write left under its number is replaced."""
    spark = df.sparkSession
    version = current_version(spark, path) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={version:06d}")
    _mark(spark, path, version)
    return version


def _mark(spark: SparkSession, path: str, version: int) -> None:
    spark.range(0, 1, 1, 1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{path}/finished")


def upsert(old: DataFrame, new: DataFrame, key: str, newest: Column) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; of several new rows for a key the
    newest counts."""
    fresh = latest(new, key, newest).select(*old.columns)
    return old.join(fresh, key, "left_anti").unionByName(fresh)


def snapshot_rows(walked: DataFrame, scan_time: Column | None = None) -> DataFrame:
    """Nodes of a walk as the snapshot keeps them (`schemas.NODE_SNAPSHOT`), with their place in it."""
    return walked.select(
        "node_token",
        "parent_node_token",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("obj_type", F.lit("")).alias("obj_type"),
        F.coalesce("has_child", F.lit(False)).alias("has_child"),
        F.coalesce("node_type", F.lit("")).alias("node_type"),
        (F.current_timestamp() if scan_time is None else scan_time).alias("scan_time"),
        F.struct("parent_place", "ord").alias("place"),
    )


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """All nodes of a snapshot: of each bucket the newest version that has its mark."""
    marks = _bucket_marks(spark, path)
    if not marks:
        return spark.createDataFrame([], schemas.NODE_SNAPSHOT)
    folders = [f"{path}/version={version:06d}/{BUCKET}={bucket}" for bucket, version in sorted(marks.items())]
    return spark.read.schema(schemas.NODE_SNAPSHOT).parquet(*folders)


def _bucket_marks(spark: SparkSession, path: str) -> dict[int, int]:
    """Newest finished version of each bucket; at most SNAPSHOT_BUCKETS rows."""
    marks = _read(spark, f"{path}/finished", "bucket INT, version INT")
    return {} if marks is None else {r[0]: r[1] for r in marks.groupBy("bucket").agg(F.max("version")).collect()}


def upsert_snapshot(rows: DataFrame, path: str) -> list[int]:
    """Renew a snapshot by `snapshot_rows`; returns the buckets that were written.

    Nodes lie in hash buckets. A node that is as it was keeps its row, `scan_time` included; only buckets with new or changed
    nodes are written, as a next version, and switched together by one file of marks. Of a node listed twice, the last
    place counts. An interrupted write leaves all buckets as they were."""
    spark = rows.sparkSession
    marks = _bucket_marks(spark, path)
    version = max(marks.values(), default=0) + 1
    old = read_snapshot(spark, path)
    compared = [c for c in old.columns if c not in ("node_token", "scan_time")]
    fresh = latest(rows, "node_token", F.col("place")).select(*old.columns)
    known = old.select("node_token", F.struct(*compared).alias("known"))
    changed = fresh.join(known, "node_token", "left").filter(~F.struct(*compared).eqNullSafe(F.col("known"))).drop("known")
    bucket = F.pmod(F.xxhash64("node_token"), F.lit(SNAPSHOT_BUCKETS)).cast("int")
    changed = stage(changed.withColumn(BUCKET, bucket), f"{path}/changed/version={version:06d}")
    touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
    if touched:
        kept = old.withColumn(BUCKET, bucket).filter(F.col(BUCKET).isin(touched)).join(changed, "node_token", "left_anti")
        after = kept.unionByName(changed).hint("rebalance", BUCKET)
        after.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/version={version:06d}")
        written = spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, touched))).alias("bucket"), F.lit(version).alias("version"))
        written.write.mode("append").parquet(f"{path}/finished")
    return touched


def save_contents(contents: DataFrame, table: str, buckets: int) -> None:
    """Contents as a catalog table laid out by `doc_id`. Runs that read it (`spark.table`) join bodies where they
    are: only ids and labels are shuffled."""
    laid_out = contents.repartition(buckets, "doc_id").write.mode("overwrite")
    laid_out.bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(table)


def content_part(doc_id: Column, parts: int) -> Column:
    """The part of the bodies an id belongs to; no id belongs to the first."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(parts)), F.lit(0)).cast("int")


def save_content_parts(contents: DataFrame, path: str, parts: int) -> None:
    """Contents in a folder for each part, so that a run in several commits reads each body in one of them. A document with
    very many responses is one large key of one part: rebalancing writes that part by several tasks."""
    laid_out = contents.withColumn(PART, content_part(F.col("doc_id"), parts)).hint("rebalance", PART)
    laid_out.write.mode("overwrite").partitionBy(PART).parquet(path)


def save_leaf_set(leaves: DataFrame, path: str, space_id: str, scan_root: str) -> None:
    """Keep the result of a finished walk as the next version for its root; other roots are not touched."""
    write_next(leaves, _part(path, space_id=space_id, scan_root=scan_root))


def load_leaf_set(spark: SparkSession, path: str, space_id: str, scan_root: str) -> DataFrame | None:
    """The newest finished result of that walk, or None. Reads the one folder only."""
    folder = _part(path, space_id=space_id, scan_root=scan_root)
    version = current_version(spark, folder)
    return spark.read.parquet(f"{folder}/version={version:06d}") if version else None


def ledger_rows(done: DataFrame, scan_root: str, target_root: str | None, at: Column | None = None) -> DataFrame:
    """Ledger entries for processed nodes, each once."""
    return done.select("node_token").distinct().select(
        "node_token",
        F.lit(scan_root).alias("scan_root"),
        F.lit(target_root).cast("string").alias("target_root"),
        (F.current_timestamp() if at is None else at).alias("processed_at"),
    )


def ledger_from_progress(progress: DataFrame, target_root: str | None = None) -> DataFrame:
    """Ledger from progress files as the reference writes them, one JSON object per file with `processed_tokens`,
    `last_update`, `scan_root` and perhaps a target name; read them with `multiLine`."""
    return progress.select(
        F.explode("processed_tokens").alias("node_token"),
        "scan_root",
        F.lit(target_root).cast("string").alias("target_root"),
        F.to_timestamp("last_update").alias("processed_at"),
    )


def cache_from_tags(rows: DataFrame, version: Column | str) -> DataFrame:
    """Cache from rows `(obj_token, content_hash, tag_json, updated_at)` as the reference keeps them, taken to
    belong to a label tree."""
    return rows.select(
        "obj_token",
        "content_hash",
        (F.lit(version) if isinstance(version, str) else version).alias("taxonomy_version"),
        path_from_tags(F.col("tag_json")).alias("path"),
        "tag_json",
        F.to_timestamp("updated_at").alias("updated_at"),
    )


def newest_entries(ledger: DataFrame) -> DataFrame:
    """The latest ledger entry of every node in a scan root."""
    return (
        ledger.groupBy("node_token", "scan_root")
        .agg(F.max(F.struct("processed_at", "target_root")).alias("latest"))
        .select("node_token", "scan_root", "latest.target_root", "latest.processed_at")
    )


def processed_nodes(ledger: DataFrame, scan_root: str | None, enabled: bool = True, force: bool = False) -> DataFrame:
    """Nodes done before under this scan root; none if the ledger is off or a rescan is forced."""
    if not enabled or force:
        return ledger.select("node_token").filter(F.lit(False))
    return ledger.filter(F.col("scan_root").eqNullSafe(F.lit(scan_root))).select("node_token")


def annotated_sources(routed: DataFrame) -> DataFrame:
    """The source documents with their tag lines before their bodies; those without a tag line are not annotated."""
    annotated = routed.withColumn("annotated_content", annotated_body(F.col("tag_line"), F.col("content")))
    return annotated.filter("annotated_content is not null").select("node_token", "obj_token", "title", "tag_line", "annotated_content")


def write_output(bodies: DataFrame, path: str) -> int:
    """Routed documents (`schemas.ROUTED`) and annotated sources (`schemas.ANNOTATED`), in the folder of a new attempt. Both
    become visible by one mark, written last: a run that breaks off leaves the output of the attempt before.

    Routed documents are partitioned by their folder labels. The rebalance hint lets adaptive execution split a label that
    holds much of the data over many writers, and merge small labels, to files of the advisory size. What is annotated is
    made of the routed documents as they were written, so bodies are joined once.
    """
    spark = bodies.sparkSession
    version = current_version(spark, path) + 1
    folder = f"{path}/version={version:06d}"
    dealt = bodies.hint("rebalance", "tag1", "tag2", "tag3")
    dealt.write.mode("overwrite").partitionBy("tag1", "tag2", "tag3").parquet(f"{folder}/{ROUTED}")
    routed = spark.read.schema(schemas.ROUTED).parquet(f"{folder}/{ROUTED}")
    annotated_sources(routed).write.mode("overwrite").parquet(f"{folder}/{ANNOTATED}")
    _mark(spark, path, version)
    return version


def read_output(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All `ROUTED` or `ANNOTATED` documents of the newest finished attempt; none before the first."""
    schema = {ROUTED: schemas.ROUTED, ANNOTATED: schemas.ANNOTATED}[kind]
    version = current_version(spark, path)
    if version == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version={version:06d}/{kind}")
