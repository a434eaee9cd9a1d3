import json
import random

from pyspark.sql import functions as F

from docgrove.functions import labels
from docgrove.operators import classify, matching
from docgrove.sources import taxonomy
from workload import rules, views

TREE = {
    "Radio": {
        "Bands": {"Long": [], "Short": []},
        "Audio": {},
        "Tests": {"Boot": {"license": []}, "Sleep": []},
    },
    "Vision": {"Lens": ["Wide", "Tele"], "Audio": {}},
    "Audio": {},
    "Services": {},
    "Lists": ["A&B", "C/D", "标签"],
    "Others": {},
}


def _paths(node, prefix=""):
    """Every path, the parent before its children."""
    for label in node:
        path = f"{prefix} -> {label}" if prefix else label
        yield path
        children = node[label] if isinstance(node, dict) else []
        yield from _paths(children, path)


def _loaded(spark, tree):
    return taxonomy.from_json_text(spark.createDataFrame([(json.dumps(tree),)], "value string"))


def _best(answer, paths):
    """Rank of every path by the rule that accepts it; the least rank counts."""
    if answer in ("", "Others"):
        return "Others"
    end = answer.rsplit(" -> ", 1)[-1]
    rules_in_turn = [
        lambda p: p == answer,
        lambda p: answer in p or p in answer,
        lambda p: p == end or p.endswith(" -> " + end),
    ]
    ranked = [(tier, n, p) for n, p in enumerate(paths) for tier, rule in enumerate(rules_in_turn) if rule(p)]
    return min(ranked)[2] if ranked else "Others"


def _matched(spark, answers, tree_rows):
    rows = spark.createDataFrame([(str(n), a, None) for n, a in enumerate(answers)], "obj_key string, raw_response string, error string")
    found = classify.label_answers(rows, matching.label_index(tree_rows))
    return found.orderBy(F.col("obj_key").cast("int")).collect()


def test_tree_from_json_keeps_order(spark):
    rows = _loaded(spark, TREE).orderBy("ord_path").collect()
    assert [r["path"] for r in rows] == list(_paths(TREE))
    by_path = {r["path"]: r for r in rows}
    assert by_path["Vision -> Lens -> Wide"]["listed"] and not by_path["Vision -> Lens"]["listed"]
    assert by_path["Radio -> Tests -> Boot -> license"]["depth"] == 4
    assert not by_path["Radio -> Tests"]["is_leaf"] and by_path["Radio -> Audio"]["is_leaf"]
    assert by_path["Radio -> Bands -> Long"]["parent_path"] == "Radio -> Bands"


def test_tree_from_file(spark, tmp_path):
    file = tmp_path / "labels.json"
    file.write_text(json.dumps(TREE, ensure_ascii=False, indent=2), encoding="utf-8")
    rows = taxonomy.from_json(spark, str(file)).orderBy("ord_path").collect()
    assert [r["path"] for r in rows] == list(_paths(TREE))


def test_outline(spark):
    tree_rows = _loaded(spark, TREE)
    text = spark.range(1).select(taxonomy.outline(tree_rows)).first()[0]
    assert text.split("\n") == [
        "- Radio:",
        "  - Bands:",
        "    - Long",
        "    - Short",
        "  - Audio",
        "  - Tests:",
        "    - Boot:",
        "      - license",
        "    - Sleep",
        "- Vision:",
        "  - Lens",
        "      Wide、Tele",
        "  - Audio",
        "- Audio:",
        "- Services:",
        "- Lists:",
        "    A&B、C/D、标签",
        "- Others:",
    ]


def test_roots_search_and_stats(spark):
    tree_rows = _loaded(spark, TREE)
    assert [r["path"] for r in taxonomy.roots(tree_rows).collect()] == list(TREE)
    found = {r["path"] for r in taxonomy.search(tree_rows, "AUDIO").collect()}
    assert found == {"Radio -> Audio", "Vision -> Audio", "Audio"}
    assert taxonomy.stats(tree_rows).first()["n_paths"] == len(list(_paths(TREE)))


def test_match_edge_cases(spark):
    expected = {
        "": ("Others", labels.FALLBACK),
        "Others": ("Others", labels.EXACT),
        "Others -> foo": ("Others", labels.CONTAINED),
        "Audio": ("Audio", labels.EXACT),
        "audio": ("Others", labels.FALLBACK),
        "Short": ("Radio -> Bands -> Short", labels.CONTAINED),
        "Radio -> Short": ("Radio", labels.CONTAINED),
        "Radio -> Tests -> Foo": ("Radio", labels.CONTAINED),
        "Nowhere -> Tele": ("Vision -> Lens -> Tele", labels.LAST_LEVEL),
        "Tests -> Boot": ("Radio -> Tests -> Boot", labels.CONTAINED),
        "R": ("Radio", labels.CONTAINED),
        "nothing": ("Others", labels.FALLBACK),
    }
    rows = _matched(spark, list(expected), _loaded(spark, TREE))
    assert {r["answer"]: (r["path"], r["match_tier"]) for r in rows} == expected


def test_match_equals_brute_force(spark):
    paths = list(_paths(TREE))
    rng = random.Random(3)
    pieces = [p for path in paths for p in path.split(" -> ")] + ["x", "Rad", "io", "标"]
    answers = [rng.choice([" -> ", "->", " "]).join(rng.choices(pieces, k=rng.randint(1, 3))) for _ in range(2000)]
    rows = _matched(spark, answers, _loaded(spark, TREE))
    assert [r["path"] for r in rows] == [_best(a, paths) for a in answers]
    assert {r["path"] for r in rows} <= set(paths)


def test_fixture_answers(spark, sf):
    found = classify.label_answers(views.raw_responses(spark, sf), views.label_index(spark))
    rows = found.collect()
    assert {r["path"] for r in rows if r["error"] is None} <= set(rules.LABELS)
    assert all(r["path"] is None for r in rows if r["error"])


def test_failed_answer_has_no_label(spark):
    rows = spark.createDataFrame([("a", None, "TimeoutError: "), ("b", None, None)], "obj_key string, raw_response string, error string")
    index = matching.label_index(taxonomy.from_paths(spark.createDataFrame([(0, "A"), (1, "Others")], "ord int, path string")))
    got = {r["obj_key"]: r["path"] for r in classify.label_answers(rows, index).collect()}
    assert got == {"a": None, "b": "Others"}


def test_parts_and_tags(spark):
    paths = ["A", "A -> B ", "A -> B -> C -> D", "", "Others"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("parts", labels.path_parts(F.col("path")))
    got = df.select("parts", labels.folder_parts(F.col("parts")), labels.tag_map(F.col("parts")), labels.tag_message(F.col("parts")), labels.tag_json(F.col("parts"))).collect()
    assert [r[0] for r in got] == [["A"], ["A", "B"], ["A", "B", "C", "D"], ["Others"], ["Others"]]
    assert [len(r[1]) for r in got] == [1, 2, 3, 1, 1]
    assert got[2][2] == {"tag1": ["A"], "tag2": ["B"], "tag3": ["C"], "tag4": ["D"]}
    assert got[2][3] == "\n | Tag1: A | Tag2: B | Tag3: C | Tag4: D"
    assert json.loads(got[1][4]) == {"tag1": ["A"], "tag2": ["B"]}


def test_a_tree_may_have_any_size(spark):
    rows = spark.range(3000).selectExpr("id ord", "'label ' || id || repeat('x', 3000) path")
    loaded = taxonomy.from_paths(rows)
    assert spark.range(1).select(F.size(taxonomy.label_array(loaded))).first()[0] == 3000


def test_large_tree_and_many_answers(spark, tmp_path):
    """100,000 paths and 10,000 different answers of every kind, held against plain lookups where these are cheap."""
    rows = spark.range(100_000).selectExpr("id ord", "'area ' || id % 50 || ' -> topic ' || id % 5000 || ' -> item ' || id || 'x' path")
    matching.label_index(taxonomy.from_paths(rows)).write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    asked = spark.range(10_000).selectExpr(
        "cast(id AS string) obj_key", "cast(null AS string) error",
        """CASE id % 5 WHEN 0 THEN 'area ' || id % 50 || ' -> topic ' || id % 5000 || ' -> item ' || id || 'x'
                       WHEN 1 THEN 'item ' || id || 'x' WHEN 2 THEN 'see area ' || id % 50 || ' -> topic ' || id % 5000 || ' -> item ' || id || 'x !'
                       WHEN 3 THEN 'no such -> item ' || id || 'x' ELSE 'none ' || id END raw_response""",
    )
    found = classify.label_answers(asked, index).groupBy(F.col("obj_key").cast("int") % 5, "match_tier").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 0, 2000), (1, 1, 2000), (2, 1, 2000), (3, 2, 2000), (4, 3, 2000)]
    right = classify.label_answers(asked, index).filter("match_tier < 3 and not path like '%item ' || obj_key || 'x'").count()
    assert right == 0
