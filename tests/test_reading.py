import json

from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.operators import reading
from docgrove.sources import responses

LEAF = "node_token string, obj_token string, title string, depth int, parent_place bigint, ord bigint"

CONTENTS = [
    ("D1", 0, "one"),
    ("D2", 0, " \t\n　"),
    ("K2", 0, "never asked for, the blank answer counts"),
    ("D3", 1, None),
    ("K3", 0, "three by node"),
    ("D4", 1, None),
    ("K4", 1, None),
    ("R4", 0, "four by resolved object"),
    ("D5", 1, None),
    ("K6", 0, "six without object"),
]


def _docs(spark):
    rows = [(f"K{n}", None if n == 6 else f"D{n}", f"t{n}", 1, 0, n) for n in range(1, 8)]
    return reading.with_obj_key(spark.createDataFrame(rows, LEAF)).select("obj_key", "node_token", "title")


def _contents(spark):
    return spark.createDataFrame(CONTENTS, "doc_id string, code int, content string")


def _infos(spark):
    rows = [("K4", "docx", "R4"), ("K5", "sheet", "D1"), ("K7", "docx", ""), ("K7", None, None)]
    return spark.createDataFrame(rows, "node_token string, obj_type string, obj_token string")


def test_first_success_counts(spark):
    read = reading.read_contents(_docs(spark), _contents(spark), _infos(spark)).collect()
    got = {r["node_token"]: (r["response_id"], r["read_status"], r["content"]) for r in read}
    assert got == {
        "K1": ("D1", "ok", "one"),
        "K2": ("D2", "empty", None),
        "K3": ("K3", "ok", "three by node"),
        "K4": ("R4", "ok", "four by resolved object"),
        "K5": (None, "missing", None),
        "K6": ("K6", "ok", "six without object"),
        "K7": (None, "missing", None),
    }


def test_without_lookup_table(spark):
    status = {r["node_token"]: r["read_status"] for r in reading.read_status(_docs(spark), _contents(spark)).collect()}
    assert status["K4"] == "missing" and status["K3"] == "ok"


def test_hash_stored_at_ingest_gives_the_same(spark):
    bodies = [(d, None, json.dumps({"code": c, "msg": "", "data": {"content": t}})) for d, c, t in CONTENTS]
    ingested = responses.contents(spark.createDataFrame(bodies, schemas.DOCUMENT_RESPONSES))
    ours = reading.read_status(_docs(spark), ingested, _infos(spark)).collect()
    raw = reading.read_status(_docs(spark), _contents(spark), _infos(spark)).collect()
    assert sorted(ours) == sorted(raw)


def test_summary_counts_every_listing(spark):
    rows = [("K1", "D1", "t", 1, 0, 0), ("K1", "D1", "t", 2, 1, 1), ("X1", "D1", "t", 1, 0, 3), ("K2", "D2", "t", 1, 0, 1)]
    leaves = spark.createDataFrame(rows + [("K5", "D5", "t", 1, 0, 4)] * 3, LEAF)
    summary = reading.read_summary(reading.read_status(reading.listings(leaves), _contents(spark))).first()
    assert summary.asDict() == {"total": 7, "ok": 3, "empty": 4, "missing": 3}


def test_last_node_of_an_object(spark):
    rows = [
        ("a", "D1", "first", 1, 0, 5),
        ("b", "D1", "deeper", 2, 1, 1),
        ("c", "D1", "same depth, later", 2, 1, 2),
        ("d", "D2", "only", 3, 2, 0),
        ("e", "", "no object", 1, 0, 1),
        ("f", None, "no object", 1, 0, 2),
    ]
    kept = {r["obj_key"]: r["node_token"] for r in reading.dedupe_objects(spark.createDataFrame(rows, LEAF)).collect()}
    assert kept == {"D1": "c", "D2": "d", "e": "e", "f": "f"}


def test_resolution(spark):
    tokens = spark.createDataFrame([("K4",), ("K5",), ("K7",), ("D9",)], "node_token string")
    strict = {r[0]: r[1] for r in reading.resolve_strict(tokens, _infos(spark)).collect()}
    lenient = {r[0]: r[1] for r in reading.resolve_lenient(tokens, _infos(spark)).collect()}
    assert strict == {"K4": "R4", "K5": None, "K7": None, "D9": None}
    assert lenient == {"K4": "R4", "K5": None, "K7": None, "D9": "D9"}


def test_node_infos_from_bodies(spark):
    bodies = [
        ("a", None, '{"code":0,"data":{"node":{"obj_token":"D1","obj_type":"docx"}}}'),
        ("b", None, '{"code":1,"msg":"no"}'),
        ("c", None, "busy"),
    ]
    infos = responses.node_infos(spark.createDataFrame(bodies, schemas.NODE_RESPONSES))
    assert [tuple(r) for r in infos.select("node_token", "obj_token").collect()] == [("a", "D1")]


def test_titles_from_bodies(spark):
    bodies = [("a", 2, '{"code":0,"data":{"document":{"title":"T"}}}'), ("b", None, '{"code":1}'), ("c", None, "busy")]
    bodies += [("a", 1, '{"code":0,"data":{"document":{"title":"Z"}}}'), ("a", 3, '{"code":1}'), bodies[0]]
    titles = responses.titles(spark.createDataFrame(bodies, schemas.DOCUMENT_RESPONSES))
    assert {tuple(r) for r in titles.collect()} == {("a", "T"), ("b", None), ("c", None)}


def test_many_nodes_of_one_object(spark):
    """A third of all nodes lead to one object: its partition is divided, and no listing is lost."""
    leaves = spark.range(90_000).select(
        F.concat(F.lit("n"), "id").alias("node_token"),
        F.when(F.col("id") % 3 == 0, F.lit("D1")).otherwise(F.concat(F.lit("E"), "id")).alias("obj_token"),
        F.lit("t").alias("title"),
    )
    summary = reading.read_summary(reading.read_status(reading.listings(leaves), _contents(spark))).first()
    assert (summary["total"], summary["ok"]) == (90_000, 30_000)
