"""Runs one after the other over the same state."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.operators import tree
from docgrove.plans.run import Inputs, Settings, commit_bodies, commit_parts, run
from docgrove.sources import tables, taxonomy

NODE = "node_token string, parent_node_token string, title string, obj_type string, obj_token string, has_child boolean, node_type string, url string, ord bigint"
PATHS = ["Radio", "Radio -> 007", "Radio -> A/B & 标签", "Radio -> A/B & 标签 -> Deep", "Radio -> A/B & 标签 -> Deep -> Deeper", "Others"]
ANSWERS = {"D1": "Radio -> 007", "D2": "Radio -> A/B & 标签 -> Deep -> Deeper", "D3": "nothing fits", "D6": "Radio"}


def _node(token, parent, title, obj, inner=False, position=0, obj_type="docx"):
    return (token, parent, title, obj_type, obj, inner, "origin", None, position)


def _nodes(spark):
    return spark.createDataFrame(
        [
            _node("ROOT", None, "Root", "OROOT", True),
            _node("TARGET", None, "Target", "OT", True, 1),
            _node("F1", "TARGET", "Radio", "OF1", True, 0),
            _node("IN", "ROOT", "Index", "OIN", True, 0),
            _node("K1", "ROOT", "one", "D1", position=1),
            _node("K2", "IN", "two", "D2", position=0),
            _node("K3", "IN", "three", "D3", position=1),
            _node("K4", "IN", "blank", "D4", position=2),
            _node("K5", "IN", "fails", "D5", position=3),
            _node("K6", "IN", "no object", None, position=4),
            _node("K7", "IN", "sheet", "D7", position=5, obj_type="sheet"),
        ],
        NODE,
    )


def _contents(spark, **changed):
    bodies = {"D1": "one", "D2": "two", "D3": "three", "D4": " ", "D5": "five", "K6": "six"} | changed
    return spark.createDataFrame([(d, 0, b) for d, b in bodies.items()], "doc_id string, code int, content string")


def _provider(folder):
    """Answers by document, and leaves a note of every call."""

    def make():
        def answer(obj_key, request):
            with open(f"{folder}/calls", "a") as calls:
                calls.write(obj_key + "\n")
            if obj_key == "D5":
                raise TimeoutError("busy")
            assert request.startswith("- Radio:") and "标题: " in request
            return ANSWERS.get(obj_key, "Radio")

        return answer

    return make


def _calls(folder):
    file = folder / "calls"
    found = sorted(file.read_text().split()) if file.exists() else []
    file.unlink(missing_ok=True)
    return found


@pytest.fixture
def start(spark, tmp_path):
    def go(run_id, contents=None, **settings):
        labels = taxonomy.from_paths(spark.createDataFrame(list(enumerate(PATHS)), "ord int, path string"))
        inputs = Inputs(_nodes(spark), contents or _contents(spark), labels, _provider(tmp_path))
        base = Settings(f"{tmp_path}/state", f"{tmp_path}/output", run_id, scan_name="Root", target_name="Target")
        return run(inputs, dataclasses.replace(base, **settings))

    return go


def _status(result):
    return {r["node_token"]: r["status"] for r in result.outcomes.collect()}


def test_first_run(spark, start, tmp_path):
    result = start("1")
    assert (result.scan_root, result.target_root) == ("ROOT", "TARGET")
    assert _status(result) == {
        "K1": "success", "K2": "success", "K3": "success", "K4": "empty", "K5": "failed", "K6": "failed",
    }
    assert _calls(tmp_path) == ["D1", "D2", "D3", "D5", "K6"]
    assert result.stats.first().asDict() == {
        "found": 6, "non_leaf_docx_skipped": 1, "success": 3, "failed": 2, "skipped": 1, "empty": 1, "success_rate": 60.0,
    }
    assert result.classify_stats.first().asDict() == {"total": 5, "ok": 4, "failed": 1, "cached": 0, "empty": 1}
    routed = {r["node_token"]: r for r in result.routed.collect()}
    annotated = {r["node_token"]: r["annotated_content"] for r in result.annotated.collect()}
    assert annotated == {n: r["annotated_content"] for n, r in routed.items()}
    assert (routed["K1"]["tag1"], routed["K1"]["tag2"], routed["K1"]["tag3"]) == ("Radio", "007", None)
    assert (routed["K2"]["tag2"], routed["K2"]["tag3"]) == ("A/B & 标签", "Deep")
    assert routed["K2"]["tag_line"] == "| Tag1: Radio | Tag2: A/B & 标签 | Tag3: Deep | Tag4: Deeper"
    assert routed["K2"]["annotated_content"] == routed["K2"]["tag_line"] + "\ntwo"
    assert routed["K2"]["content"] == "two"
    folders = {"/".join(r["folders"]): r for r in result.folders.collect()}
    assert folders["Radio"]["node_token"] == "F1" and not folders["Radio"]["created"]
    assert folders["Radio/007"]["parent_token"] == "F1" and folders["Radio/007"]["created"]
    assert routed["K1"]["target_parent"] == folders["Radio/007"]["node_token"]
    assert len(folders) == 5


def test_second_run_takes_up_what_is_left(spark, start, tmp_path):
    start("1")
    _calls(tmp_path)
    result = start("2")
    assert _status(result) == {"K4": "empty", "K5": "failed", "K6": "failed"}
    assert _calls(tmp_path) == ["D5"]
    assert result.stats.first()["skipped"] == 4
    ledger = tables.read_log(spark, f"{tmp_path}/state/ledger", schemas.LEDGER)
    assert sorted(r["node_token"] for r in ledger.collect()) == ["K1", "K2", "K3"]


def test_forced_run_uses_the_cache_unless_bodies_changed(spark, start, tmp_path):
    start("1")
    _calls(tmp_path)
    result = start("2", force=True)
    assert _calls(tmp_path) == ["D5"]
    assert result.classify_stats.first()["cached"] == 4
    start("3", contents=_contents(spark, D2="two, changed"), force=True)
    assert _calls(tmp_path) == ["D2", "D5"]
    start("4", contents=_contents(spark, D2="two, changed"), force=True)
    assert _calls(tmp_path) == ["D5"]
    start("5", force=True, use_cache=False)
    assert _calls(tmp_path) == ["D1", "D2", "D3", "D5", "K6"]
    log = tables.read_log(spark, f"{tmp_path}/state/cache", schemas.CACHE)
    cache = tables.latest(log, "obj_token", F.col("updated_at"))
    assert sorted(r["obj_token"] for r in cache.collect()) == ["D1", "D2", "D3", "K6"]


def test_other_label_tree_is_not_served_from_the_cache(spark, start, tmp_path, monkeypatch):
    start("1")
    _calls(tmp_path)
    monkeypatch.setitem(globals(), "PATHS", [*PATHS, "New"])
    start("2", force=True)
    assert _calls(tmp_path) == ["D1", "D2", "D3", "D5", "K6"]


def test_ledger_belongs_to_the_scan_root(start, tmp_path):
    start("1")
    assert _status(start("2", scan_root="IN")) == {
        "K2": "success", "K3": "success", "K4": "empty", "K5": "failed", "K6": "failed",
    }


def test_limit_before_done_ones_are_dropped(start):
    first = start("1", max_documents=2)
    assert _status(first) == {"K1": "success", "K2": "success"}
    again = start("2", max_documents=2)
    assert _status(again) == {}
    assert again.stats.first().asDict() == {
        "found": 2, "non_leaf_docx_skipped": 1, "success": 0, "failed": 0, "skipped": 2, "empty": 0, "success_rate": None,
    }


def test_repeated_run_replaces_its_output(spark, start, tmp_path):
    start("1")
    _calls(tmp_path)
    result = start("1")
    assert result.routed.count() == 3
    assert _calls(tmp_path) == ["D5"]
    assert tables.read_log(spark, f"{tmp_path}/state/ledger", schemas.LEDGER).count() == 3


def test_scan_is_reused(start):
    first = start("1")
    again = start("2", reuse_scan=True, force=True)
    columns = ["node_token", "depth", "parent_place", "ord"]
    assert sorted(first.leaves.select(columns).collect()) == sorted(again.leaves.select(columns).collect())
    assert again.stats.first()["non_leaf_docx_skipped"] == 0


def test_parts_and_options(start, tmp_path):
    result = start("1", commits=3, add_tags=False)
    assert _calls(tmp_path) == ["D1", "D2", "D3", "D5", "K6"]
    assert {r["tag_line"] for r in result.routed.collect()} == {None}
    assert {r["annotated_content"] for r in result.routed.collect()} == {None}
    assert result.annotated.count() == 0


def test_missing_root_is_an_error(start):
    with pytest.raises(ValueError):
        start("1", scan_name="Nowhere")


def test_new_target_at_the_top_of_the_space(start):
    result = start("1", target_name=None)
    assert {r["parent_token"] for r in result.folders.collect() if r["level"] == 1} == {""}


def test_upsert_keeps_the_newest(spark):
    schema = "k string, v string, at int"
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], schema)
    new = spark.createDataFrame([("b", "newer", 3), ("b", "new", 2), ("c", "new", 2)], schema)
    assert {r["k"]: r["v"] for r in tables.upsert(old, new, "k", F.col("at")).collect()} == {
        "a": "old", "b": "newer", "c": "new",
    }


def test_versions(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert tables.read_current(spark, path, "k string").count() == 0
    for value in ("a", "b"):
        tables.write_next(spark.createDataFrame([(value,)], "k string"), path)
    assert tables.current_version(spark, path) == 2
    assert tables.read_current(spark, path, "k string").first()[0] == "b"
    spark.createDataFrame([("half",)], "k string").write.parquet(f"{path}/version=000003")  # interrupted before its mark
    assert tables.read_current(spark, path, "k string").first()[0] == "b"
    assert tables.write_next(spark.createDataFrame([("c",)], "k string"), path) == 3
    assert tables.read_current(spark, path, "k string").collect() == [("c",)]


def test_leaf_sets_by_space_and_root(spark, tmp_path):
    path = f"{tmp_path}/sets"
    assert tables.load_leaf_set(spark, path, "1", "r") is None
    leaves = tree.leaf_documents(tree.walk(_nodes(spark), "IN").rows)
    tables.save_leaf_set(leaves, path, "01", "a/b=c 标%")
    tables.save_leaf_set(leaves.filter("node_token = 'K2'"), path, "1", "IN")
    assert tables.load_leaf_set(spark, path, "01", "a/b=c 标%").count() == 5
    assert tables.load_leaf_set(spark, path, "1", "IN").count() == 1
    assert tables.load_leaf_set(spark, path, "1", "ROOT") is None
    tables.save_leaf_set(leaves.filter("false"), path, "1", "IN")
    assert tables.load_leaf_set(spark, path, "1", "IN").count() == 0


def test_snapshot_keeps_the_last_place(spark, tmp_path):
    rows = [_node("a", "r", "first", "o", position=0), _node("b", "r", "b", "o", True, 1), _node("a", "b", "last", "o")]
    nodes = spark.createDataFrame(rows, NODE)
    old = spark.createDataFrame([("z", None, "kept", "docx", False, "origin", None)], schemas.NODE_SNAPSHOT)
    path = f"{tmp_path}/nodes"
    assert tables.read_snapshot(spark, path).count() == 0
    tables.upsert_snapshot(old.withColumn("place", F.struct(F.lit(0))), path)
    tables.upsert_snapshot(tables.snapshot_rows(tree.walk(nodes, "r").rows), path)
    assert {r["node_token"]: r["title"] for r in tables.read_snapshot(spark, path).collect()} == {"z": "kept", "a": "last", "b": "b"}


def test_snapshot_writes_buckets_with_changes_only(spark, tmp_path):
    path, first, second = f"{tmp_path}/nodes", F.expr("timestamp'2024-01-01'"), F.expr("timestamp'2024-02-01'")

    def scanned(changed, at):
        rows = spark.range(1000).selectExpr(
            "'n' || id node_token", "CASE WHEN id % 9 > 0 THEN 'p' END parent_node_token", f"CASE WHEN id IN ({changed}) THEN 'new' ELSE 't' END title",
            "'docx' obj_type", "false has_child", "'origin' node_type", "0L parent_place", "id ord")
        return tables.snapshot_rows(rows, at)

    assert tables.upsert_snapshot(scanned("-1", first), path) == list(range(tables.SNAPSHOT_BUCKETS))
    assert tables.upsert_snapshot(scanned("-1", second), path) == []
    before = tables.read_snapshot(spark, path)
    assert len(tables.upsert_snapshot(scanned("7", second), path)) == 1
    after = {r["node_token"]: (r["title"], r["scan_time"].month) for r in tables.read_snapshot(spark, path).collect()}
    assert after == {f"n{n}": ("new", 2) if n == 7 else ("t", 1) for n in range(1000)}
    assert before.count() == 1000  # who reads the version before is not disturbed
    # Broken off before the marks: all buckets stay as they were.
    tables.read_snapshot(spark, path).limit(3).withColumn("bucket", F.lit(5)).write.partitionBy("bucket").parquet(f"{path}/version=000003")
    assert {r["node_token"]: (r["title"], r["scan_time"].month) for r in tables.read_snapshot(spark, path).collect()} == after
    assert len(tables.upsert_snapshot(scanned("7, 8", second), path)) == 1
    assert tables.read_snapshot(spark, path).count() == 1000


def test_state_of_the_reference_is_taken_over(spark, tmp_path):
    (tmp_path / "progress.json").write_text(
        '{"processed_tokens": ["K1", "K2"],\n "total_processed": 2, "last_update": "2024-02-01T10:00:00.5", "scan_root": "ROOT"}'
    )
    progress = spark.read.schema(schemas.PROGRESS).json(f"{tmp_path}/progress.json", multiLine=True)
    ledger = tables.ledger_from_progress(progress, "TARGET")
    assert sorted(r[0] for r in tables.processed_nodes(ledger, "ROOT").collect()) == ["K1", "K2"]
    assert tables.processed_nodes(ledger, "OTHER").count() == 0
    rows = [("D1", "h", '{"tag1": ["A"], "tag2": ["B C"]}', "2024-02-01T10:00:00.123456"), ("D2", "h", '{"tag1": ["Others"]}', "2024-02-01T10:00:00")]
    cache = tables.cache_from_tags(spark.createDataFrame(rows, schemas.TAG_CACHE), "v")
    assert {r["obj_token"]: r["path"] for r in cache.collect()} == {"D1": "A -> B C", "D2": "Others"}


def test_one_body_for_a_document_that_answered_several_times(spark, start, tmp_path):
    rows = [("D1", 0, 0, "old one"), ("D1", 2, 0, "one"), ("D1", 3, 1, None), ("D2", 1, 0, "two"), ("D2", 1, 0, "two")]
    contents = spark.createDataFrame(rows, "doc_id string, attempt long, code int, content string")
    result = start("1", contents)
    routed = {(r["node_token"], r["content"]) for r in result.routed.collect()}
    assert routed == {("K1", "one"), ("K2", "two")}
    assert _calls(tmp_path) == ["D1", "D2"]
    assert result.stats.first()["success"] == result.routed.count() == 2


def test_labels_may_look_like_places_in_the_template(spark, tmp_path):
    seen = tmp_path / "seen"

    def provider():
        def answer(key, request):
            seen.write_text(request)
            return "x {text} y"

        return answer

    labels = taxonomy.from_paths(spark.createDataFrame([(0, "x {text} y"), (1, "z")], "ord int, path string"))
    contents = spark.createDataFrame([("D1", 0, "body with {outline}")], "doc_id string, code int, content string")
    settings = Settings(f"{tmp_path}/state", f"{tmp_path}/output", "1", scan_name="Root", target_name="Target")
    result = run(Inputs(_nodes(spark), contents, labels, provider), settings)
    assert result.routed.count() == 1 and "x {text} y" in seen.read_text() and "body with {outline}" in seen.read_text()


def test_a_client_may_answer_lists(spark):
    class Client:
        def answer_all(self, keys, requests):
            return [ValueError("no") if k == "b" else f"{k}:{r}" for k, r in zip(keys, requests)]

    requests = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "obj_key string, text string")
    from docgrove.operators import classify

    got = {r["obj_key"]: (r["raw_response"], r["error"]) for r in classify.call_model(requests, Client, "<{text}>").collect()}
    assert got == {"a": ("a:<1>", None), "b": (None, "ValueError: no"), "c": ("c:<3>", None)}


def _files_read(df):
    """Runs `df`; how many files its scans opened, by the metrics of the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution()
    df._jdf.collectAsList()
    found, todo = 0, [plan.executedPlan()]
    while todo:
        node = todo.pop()
        inner = [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else []
        inner += [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith("Scan parquet") and "content" in node.output().toString():
            found += node.metrics().apply("numFiles").value()
    return found


def test_bodies_are_read_once_over_all_commits(spark, tmp_path):
    rows = spark.range(400).selectExpr("'D' || id doc_id", "0 code", "'body ' || id content")
    tables.save_content_parts(rows, f"{tmp_path}/contents", 8)
    contents = spark.read.parquet(f"{tmp_path}/contents")
    whole = sum(f.endswith(".parquet") for f in contents.inputFiles())
    reads = spark.range(400).selectExpr("'D' || id obj_key", "'K' || id node_token", "'D' || id response_id", "0L response_attempt")
    inputs, settings = Inputs(None, contents, None, None, content_parts=8), Settings("", "", "1", commits=4)
    parts = commit_parts(inputs, settings)
    assert sorted(p for some in parts for p in some) == list(range(8)) and len(parts) == 4
    bodies = [commit_bodies(inputs, reads, some, 8, False) for some in parts]
    assert sorted(r["content"] for b in bodies for r in b.collect()) == sorted(f"body {n}" for n in range(400))
    assert sum(map(_files_read, bodies)) == whole > 4
    assert commit_parts(Inputs(None, None, None, None, content_parts=3), settings) == [[0], [1], [2]]
    assert commit_parts(Inputs(None, None, None, None), settings) == [[0], [1], [2], [3]]


def test_run_over_laid_out_contents(spark, tmp_path):
    tables.save_content_parts(_contents(spark), f"{tmp_path}/contents", 5)
    labels = taxonomy.from_paths(spark.createDataFrame(list(enumerate(PATHS)), "ord int, path string"))
    inputs = Inputs(_nodes(spark), spark.read.parquet(f"{tmp_path}/contents"), labels, _provider(tmp_path), content_parts=5)
    result = run(inputs, Settings(f"{tmp_path}/state", f"{tmp_path}/output", "1", scan_name="Root", target_name="Target", commits=3))
    assert _calls(tmp_path) == ["D1", "D2", "D3", "D5", "K6"]
    assert sorted(r["node_token"] for r in result.routed.collect()) == ["K1", "K2", "K3"]


def test_one_failing_request_fails_alone(spark):
    from docgrove.operators import classify

    class Client:
        def answer_all(self, keys, requests):
            if "7" in keys:
                raise ConnectionError("7")
            return requests[:-1] if "40" in keys else requests  # and one that loses an answer

    requests = spark.range(64).selectExpr("cast(id AS string) obj_key", "'r' || id text").coalesce(1)
    got = {r["obj_key"]: (r["raw_response"], r["error"]) for r in classify.call_model(requests, Client).collect()}
    assert got.pop("7") == (None, "ConnectionError: 7")
    assert got.pop("40") == (None, "ValueError: 0 answers to 1 requests")
    assert got == {str(n): (f"r{n}", None) for n in range(64) if n not in (7, 40)}


def test_batches_are_bounded_in_bytes_and_number():
    from docgrove.operators import classify

    sizes = [classify.BATCH_BYTES // 2, classify.BATCH_BYTES // 2, 1, 2 * classify.BATCH_BYTES, *[1] * 300]
    batches = [[len(t) for t in texts] for _, texts in classify._batches((str(n), "x" * size) for n, size in enumerate(sizes))]
    assert [s for b in batches for s in b] == sizes
    assert [len(b) for b in batches] == [2, 1, 1, 256, 44]


LOG = "k string, v string, at int"


def test_logs_are_merged_into_a_base(spark, tmp_path):
    path = f"{tmp_path}/log"
    for n in range(6):
        tables.add_to_log(spark.createDataFrame([("a", f"a{n}", n), (f"k{n}", "x", n)], LOG), path, str(n))
    assert tables.added_parts(spark, path) == 6
    before = sorted(map(tuple, tables.latest(tables.read_log(spark, path, LOG), "k", F.col("at")).collect()))
    # Broken off before its mark: nothing changes.
    spark.createDataFrame([("a", "half", 9, "0")], f"{LOG}, run string").write.parquet(f"{path}/base/version=000001")
    assert sorted(map(tuple, tables.latest(tables.read_log(spark, path, LOG), "k", F.col("at")).collect())) == before
    tables.compact_log(spark, path, LOG, ["k"], "at")
    assert tables.read_log(spark, path, LOG).count() == 7 and tables.added_parts(spark, path) == 0
    assert sorted(map(tuple, tables.latest(tables.read_log(spark, path, LOG), "k", F.col("at")).collect())) == before
    tables.add_to_log(spark.createDataFrame([("b", "new", 7)], LOG), path, "7")
    files = tables.read_log(spark, path, LOG).inputFiles()
    assert {f.split("/log/")[1].rsplit("/", 1)[0] for f in files} == {"base/version=000001", "since=000001/run=7"}
    assert tables.read_log(spark, path, LOG).count() == 8
    assert tables.read_log(spark, path, LOG, without_run="7").count() == 7


def test_replaced_run_leaves_the_base(spark, tmp_path):
    path = f"{tmp_path}/log"
    for n in (1, 2):
        tables.add_to_log(spark.createDataFrame([(f"k{n}", "first", n), (f"m{n}", "first", n)], LOG), path, str(n), replace=True)
    tables.compact_log(spark, path, LOG, ["k"], "at")
    tables.add_to_log(spark.createDataFrame([("k1", "again", 3)], LOG), path, "1", replace=True)
    assert sorted(map(tuple, tables.read_log(spark, path, LOG).collect())) == [("k1", "again", 3), ("k2", "first", 2), ("m2", "first", 2)]
    assert tables.read_log(spark, path, LOG, without_run="1").count() == 2
    tables.compact_log(spark, path, LOG, ["k"], "at")
    assert sorted(map(tuple, tables.read_log(spark, path, LOG).collect())) == [("k1", "again", 3), ("k2", "first", 2), ("m2", "first", 2)]


def test_runs_merge_their_logs(spark, start, tmp_path):
    for n in range(3):
        start(str(n), force=True, compact_after=2)
    _calls(tmp_path)
    assert tables.current_version(spark, f"{tmp_path}/state/ledger/base") == 1
    assert _status(start("next")) == {"K4": "empty", "K5": "failed", "K6": "failed"}
    assert _calls(tmp_path) == ["D5"]


def test_output_broken_off_leaves_the_earlier_one(spark, tmp_path, monkeypatch):
    row = ("n", "o", "t", "p", "line", "body", "A", None, None)
    bodies = spark.createDataFrame([row], schemas.ROUTED)
    path = f"{tmp_path}/out"
    assert tables.read_output(spark, path, tables.ROUTED).count() == 0
    tables.write_output(bodies, path)
    open_before = tables.read_output(spark, path, tables.ROUTED)
    changed = bodies.withColumn("content", F.lit("changed")).unionByName(bodies.withColumn("tag_line", F.lit(None).cast("string")))
    with monkeypatch.context() as broken:
        broken.setattr(tables, "annotated_sources", lambda routed: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.write_output(changed, path)
    assert [r["content"] for r in tables.read_output(spark, path, tables.ROUTED).collect()] == ["body"]
    assert [r["annotated_content"] for r in tables.read_output(spark, path, tables.ANNOTATED).collect()] == ["line\nbody"]
    tables.write_output(changed, path)
    assert [r["content"] for r in open_before.collect()] == ["body"]
    assert sorted(r["content"] for r in tables.read_output(spark, path, tables.ROUTED).collect()) == ["body", "changed"]
    assert [tuple(r) for r in tables.read_output(spark, path, tables.ANNOTATED).collect()] == [("n", "o", "t", "line", "line\nchanged")]
