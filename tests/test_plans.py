"""What the physical plans must look like for the operators to hold at scale."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from docgrove.operators import classify, reading, tree
from docgrove.sources import tables, taxonomy
from workload import rules, views
from workload.stub import stub_provider


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes_above(plan, name):
    return plan[: plan.index(name)]


def test_nothing_is_filtered_after_the_model(spark, sf):
    """A filter would not move below the Python call, so all filters are placed before it."""
    docs = views.table(spark, sf, "documents").select(
        F.expr(rules.DOC_OBJECT).alias("obj_key"), F.lit("t").alias("title"), F.col("text").alias("content")
    )
    plan = _plan(classify.call_model(classify.model_requests(reading.nonblank(docs)), stub_provider))
    assert plan.count("MapInPandas") == 1
    assert "Filter" not in _nodes_above(plan, "MapInPandas")
    assert "Filter" in plan[plan.index("MapInPandas"):]
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan


def test_no_answer_is_compared_with_all_labels(spark, sf):
    """Answers are made distinct before they are looked up, and each lookup is a join on a key of the index."""
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    plan = _plan(found.select("obj_key", "path"))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert len(re.findall(r"keys=\[answer#\d+\], functions=\[\]", plan)) >= 2
    assert not re.search(r"filter\(|collect_list", plan)


def test_bodies_are_not_shuffled_to_decide_what_to_read(spark, sf):
    docs = reading.with_obj_key(views.doc_nodes(spark, sf)).select("obj_key", "node_token")
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        reading.read_status(docs, views.contents(spark, sf)).explain("formatted")
    moved = re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: (.*)", printed.getvalue())
    assert any("hash#" in columns for columns in moved)
    assert not any("content#" in columns or "text#" in columns for columns in moved)


def test_stored_hashes_spare_the_bodies(spark, tmp_path):
    stored = spark.createDataFrame([("D1", 0, "x", "hash")], "doc_id string, code int, content string, content_hash string")
    stored.write.parquet(f"{tmp_path}/contents")
    docs = spark.createDataFrame([("D1", "K1")], "obj_key string, node_token string")
    plan = _plan(reading.read_status(docs, spark.read.parquet(f"{tmp_path}/contents")))
    assert "ReadSchema: struct<doc_id:string,code:int,content_hash:string>" in plan
    assert "PushedFilters: [IsNotNull(code), EqualTo(code,0)" in plan


def test_bodies_are_parsed_once(spark, tmp_path):
    from docgrove.sources import responses

    spark.createDataFrame([("p", 0, "{}")], "parent_node_token string, page bigint, body string").write.parquet(f"{tmp_path}/l")
    nodes = responses.listing_nodes(spark.read.parquet(f"{tmp_path}/l"))
    assert _plan(nodes).count("from_json") == 1
    spark.createDataFrame([("d", "{}")], "doc_id string, body string").write.parquet(f"{tmp_path}/c")
    read = responses.contents(spark.read.parquet(f"{tmp_path}/c"))
    assert _plan(read).count("from_json") == 1


def test_last_nodes_are_aggregated_before_the_shuffle(spark):
    leaves = spark.range(10).select(
        F.concat(F.lit("n"), "id").alias("node_token"), F.lit("D").alias("obj_token"), F.lit(1).alias("depth"),
        F.col("id").alias("parent_place"), F.col("id").alias("ord"),
    )
    plan = _plan(reading.dedupe_objects(leaves))
    assert "partial_max" in plan and "Window" not in plan


def test_ledger_prunes_and_anti_joins(spark, sf):
    leaves = views.doc_nodes(spark, sf)
    done = tables.processed_nodes(views.ledger(spark, sf), rules.DOCUMENT_ROOT)
    assert "LeftAnti" in _plan(reading.pending(leaves, done))


def test_limit_needs_no_full_sort(spark):
    leaves = spark.range(1000).select(
        F.col("id").alias("node_token"), F.col("id").alias("parent_place"), F.col("id").alias("ord")
    )
    assert "TakeOrderedAndProject" in _plan(tree.first_documents(leaves, 10))


def test_folder_for_staged_tables_is_the_cluster_setting(spark):
    from docgrove import scratch

    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        assert scratch.new_folder(spark, "x").startswith(given.rstrip("/") + "/docgrove/x-")


def test_large_label_is_written_by_several_tasks(spark, tmp_path):
    """A third and more of the documents carry one label: its partition gets several files, small ones one."""
    import glob

    routed = spark.range(60_000).select(
        F.concat(F.lit("n"), "id").alias("node_token"), F.lit("o").alias("obj_token"), F.lit("t").alias("title"),
        F.lit("p").alias("target_parent"), F.lit("l").alias("tag_line"), F.sha2(F.col("id").cast("string"), 256).alias("content"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("cold"), F.col("id") % 8)).alias("tag1"),
        F.lit(None).cast("string").alias("tag2"), F.lit(None).cast("string").alias("tag3"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "600k")
    try:
        tables.write_output(routed, f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{tmp_path}/out/version=000001/routed/tag1=hot/*/*/*.parquet")) > 1
    assert tables.read_output(spark, f"{tmp_path}/out", tables.ROUTED).count() == 60_000


def test_bodies_in_buckets_stay_where_they_are(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables.save_contents(views.contents(spark, sf), "laid_out_contents", 4)
        contents = spark.table("laid_out_contents")
        docs = views.doc_nodes(spark, sf).select(
            F.col("obj_token").alias("response_id"), F.lit(1).cast("bigint").alias("response_attempt"), "node_token"
        )
        joined = reading.attach_contents(docs, contents, how="inner", repeated=False)
        once = reading.attach_contents(docs, contents, how="inner")
        assert joined.count() >= once.count() == docs.join(views.contents(spark, sf).filter("code = 0 and attempt = 1"),
                                                           F.col("response_id") == F.col("doc_id"), "left_semi").count() > 0
        plan = _plan(joined)
        body_side = plan[plan.index("Sort [answered_by"):]
        assert "Bucketed: true" in body_side and "Exchange" not in body_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS laid_out_contents")
