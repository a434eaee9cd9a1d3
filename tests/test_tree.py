import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.operators import tree

COLUMNS = "node_token string, parent_node_token string, title string, obj_type string, obj_token string, has_child boolean, ord bigint"


def _nodes(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def _random_graph(seed, count=400):
    """Nodes with wrong turns: shared children, cycles, nodes under two parents, wrong `has_child`."""
    rng = random.Random(seed)
    tokens = [f"n{n}" for n in range(count)]
    rows = []
    for n, token in enumerate(tokens):
        parents = [None] if n < 3 else [rng.choice(tokens[:n])]
        if rng.random() < 0.1:
            parents.append(rng.choice(tokens))
        inner = rng.random() < 0.7
        for parent in parents:
            rows.append([token, parent, f"t{n % 17}", rng.choice(["docx", "docx", "sheet"]), f"o{n}", inner, None])
    rng.shuffle(rows)
    for position, row in enumerate(rows):
        row[-1] = position
    return [tuple(r) for r in rows]


def _queue_walk(rows, root):
    """The walk one node at a time."""
    children = {}
    for row in sorted(rows, key=lambda r: r[-1]):
        children.setdefault(row[1], []).append(row)
    waiting, expanded, out = deque([root]), set(), []
    while waiting:
        parent = waiting.popleft()
        if parent in expanded:
            continue
        expanded.add(parent)
        for row in children.get(parent, []):
            out.append(row)
            if row[5]:
                waiting.append(row[0])
    return out, expanded


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("root", ["n0", None])
def test_walk_in_queue_order(spark, seed, root):
    rows = _random_graph(seed)
    walked = tree.walk(_nodes(spark, rows), root)
    expected, expanded = _queue_walk(rows, root)
    got = walked.rows.orderBy(*tree.BFS_ORDER).select("node_token", "parent_node_token").collect()
    assert [tuple(r) for r in got] == [(r[0], r[1]) for r in expected]
    assert {r[0] or None for r in walked.expanded.select("parent_key").collect()} == expanded
    stats = tree.scan_stats(walked).first()
    assert stats["documents_found"] == sum(r[3] == "docx" and not r[5] for r in expected)
    assert stats["non_leaf_docx_skipped"] == sum(r[3] == "docx" and r[5] for r in expected)
    assert stats["nodes_expanded"] == len(expanded)


def test_root_is_not_reached_and_cycles_end(spark):
    rows = [("a", None, "A", "docx", "oa", True, 0), ("b", "a", "B", "docx", "ob", True, 0), ("a", "b", "A", "docx", "oa", True, 0)]
    walked = tree.walk(_nodes(spark, rows), "a")
    assert sorted(tuple(r) for r in walked.rows.select("node_token", "depth").collect()) == [("a", 2), ("b", 1)]
    assert tree.walk(_nodes(spark, rows), "unknown").rows.count() == 0
    assert tree.walk(_nodes(spark, [])).rows.count() == 0


def test_one_of_several_spaces(spark):
    rows = [("a", None, "A", "docx", "oa", True, 0), ("b", "a", "B", "docx", "ob", False, 0)]
    both = _nodes(spark, rows).withColumn("space_id", F.lit("1")).union(_nodes(spark, rows[:1]).withColumn("space_id", F.lit("2")))
    assert tree.walk(both, space_id="1").rows.count() == 2
    assert tree.walk(both, space_id="2").rows.count() == 1


@pytest.mark.parametrize("depth", [30, 5000])
def test_deep_chain(spark, monkeypatch, depth):
    """Rounds grow with the logarithm of the depth."""
    rounds, stage = [], tree.scratch.stage
    monkeypatch.setattr(tree.scratch, "stage", lambda df, folder: rounds.append(folder) or stage(df, folder))
    rows = [(f"n{n}", f"n{n - 1}" if n else None, "t", "docx", "o", n < depth, 0) for n in range(depth + 1)]
    leaves = tree.leaf_documents(tree.walk(_nodes(spark, rows), "n0").rows).select("node_token", "depth").collect()
    assert [tuple(r) for r in leaves] == [(f"n{depth}", depth)]
    assert sum("/pointers-" in r for r in rounds) < 20


def test_cycles_and_missing_parents_beside_a_chain(spark):
    """Nodes that hang below a cycle, or below a parent that is not there, are not reached, however long the chain beside."""
    rows = [(f"n{n}", f"n{n - 1}" if n else None, "t", "docx", "o", True, n) for n in range(70)]
    rows += [(f"c{n}", f"c{(n + 1) % 3}", "t", "docx", "o", True, n) for n in range(3)]
    rows += [("hang", "c0", "t", "docx", "o", True, 0), ("low", "hang", "t", "docx", "o", False, 0), ("lost", "nowhere", "t", "docx", "o", True, 0)]
    rows += [("n69", "c1", "t", "docx", "o", True, 5), ("n3", "n60", "t", "docx", "o", True, 5)]
    for root in (None, "n0", "n10", "c0", "nowhere"):
        walked = tree.walk(_nodes(spark, rows), root)
        expected, expanded = _queue_walk(rows, root)
        got = walked.rows.orderBy(*tree.BFS_ORDER).select("node_token", "parent_node_token").collect()
        assert [tuple(r) for r in got] == [(r[0], r[1]) for r in expected]


def test_walk_equals_recursive_sql(spark, sf):
    from workload import views

    nodes = views.tree_nodes(spark, sf)
    nodes.createOrReplaceTempView("tree_nodes")
    recursive = spark.sql(
        """WITH RECURSIVE walked(node_token, has_child, depth) AS (
            SELECT node_token, has_child, 1 FROM tree_nodes WHERE parent_node_token = 'R1'
            UNION ALL
            SELECT n.node_token, n.has_child, w.depth + 1 FROM tree_nodes n JOIN walked w ON n.parent_node_token = w.node_token
            WHERE w.has_child)
        SELECT node_token, depth FROM walked"""
    )
    ours = tree.walk(nodes, "R1").rows.select("node_token", "depth")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, recursive.collect()))


def test_limit_comes_first_in_queue_order(spark):
    rows = _random_graph(5)
    leaves = tree.leaf_documents(tree.walk(_nodes(spark, rows)).rows)
    expected = [r[0] for r in _queue_walk(rows, None)[0] if r[3] == "docx" and not r[5]]
    first = tree.first_documents(leaves, 20).orderBy(*tree.BFS_ORDER).collect()
    assert [r["node_token"] for r in first] == expected[:20]
    assert tree.first_documents(leaves, 0).count() == len(expected)


def test_rows_of_a_walk_have_no_arrays_and_expanded_nodes_their_queue_numbers(spark):
    rows = _random_graph(6)
    walked = tree.walk(_nodes(spark, rows))
    assert "array" not in " ".join(kind for _, kind in walked.rows.dtypes + walked.expanded.dtypes)
    order, seen = [], set()
    for row in [(None,) * 6, *_queue_walk(rows, None)[0]]:
        token = row[0]
        if (token is None or row[5]) and token not in seen:
            seen.add(token)
            order.append(token or "")
    assert [r["parent_key"] for r in walked.expanded.orderBy("place").collect()] == order
    assert sorted(r["place"] for r in walked.expanded.collect()) == list(range(len(order)))


def test_large_limit_is_found_by_numbers(spark, monkeypatch):
    rows = _random_graph(5)
    leaves = tree.leaf_documents(tree.walk(_nodes(spark, rows)).rows)
    expected = [r["node_token"] for r in leaves.orderBy(*tree.BFS_ORDER).collect()]
    monkeypatch.setattr(tree, "SMALL_LIMIT", 5)
    first = tree.first_documents(leaves, 33)
    assert "TakeOrdered" not in first._jdf.queryExecution().executedPlan().toString()
    assert [r["node_token"] for r in first.orderBy(*tree.BFS_ORDER).collect()] == expected[:33]


def _flat(spark):
    rows = [
        ("x", None, "same", "docx", "ox", False, 7),
        ("y", None, "same", "docx", "oy", False, 2),
        ("z", "", "top", "docx", "oz", False, 3),
        ("w", "x", "below", "docx", "ow", False, 0),
        ("v", "x", "", "docx", "ov", False, 1),
        ("u", "x", "below", "docx", "ou", False, 2),
    ]
    return _nodes(spark, rows)


def test_lookups_by_title(spark):
    nodes = _flat(spark)
    assert tree.find_by_title(nodes, "same").first()[0] == "y"
    assert tree.find_by_title(nodes, "top").first()[0] == "z"
    assert tree.find_by_title(nodes, "below").first()[0] is None
    assert tree.scan_root(nodes, name="same") == "y"
    with pytest.raises(ValueError):
        tree.scan_root(nodes, name="below")
    assert tree.target_root(nodes, fallback="top") == "z"
    assert tree.target_root(nodes, fallback="VtopX", token_prefix="V") == "VtopX"
    assert tree.target_root(nodes) is None


def test_children_by_title(spark):
    children = {(r["parent_key"], r["title"]): r["node_token"] for r in tree.child_map(_flat(spark)).collect()}
    assert children == {("", "same"): "x", ("", "top"): "z", ("x", "below"): "u"}
    twice = {(r["parent_key"], r["title"], r["occurrences"]) for r in tree.duplicate_titles(_flat(spark)).collect()}
    assert twice == {("", "same", 2), ("x", "below", 2)}
    counts = {r["parent_key"]: r["total_count"] for r in tree.title_counts(_flat(spark)).collect()}
    assert counts == {"": 2, "x": 1}
    wanted = spark.createDataFrame([("x", "below"), ("x", "below"), ("y", "below")], "parent_key string, title string")
    checked = {(r["parent_key"], r["is_duplicate"], r["node_token"]) for r in tree.check_titles(_flat(spark), wanted).collect()}
    assert checked == {("x", True, "u"), ("y", False, None)}


def test_listing_from_json_lines(spark, tmp_path):
    from docgrove.sources import responses

    (tmp_path / "calls.json").write_text(
        '{"parent_node_token":null,"page":1,"body":"{\\"code\\":0,\\"data\\":{\\"items\\":[{\\"node_token\\":\\"b\\"},{\\"title\\":\\"no token\\"}]}}"}\n'
        '{"parent_node_token":null,"page":0,"body":"{\\"code\\":0,\\"data\\":{\\"items\\":[{\\"node_token\\":\\"a\\",\\"has_child\\":true}]}}"}\n'
        '{"parent_node_token":"a","page":0,"body":"{\\"code\\":131006,\\"msg\\":\\"denied\\"}"}\n'
        '{"parent_node_token":"b","page":0,"body":"<html>"}\n'
        '{"parent_node_token":"c","page":0,"body":"{\\"code\\":0,\\"data\\":{}}"}\n'
    )
    calls = responses.read_responses(spark, str(tmp_path), schemas.LISTING_RESPONSES)
    nodes = {r["node_token"]: (r["has_child"], r["ord"]) for r in responses.listing_nodes(calls).collect()}
    assert nodes == {"a": (True, 0), "b": (False, 1 << 32)}
    errors = {r["parent_node_token"]: (r["code"], r["msg"]) for r in responses.listing_errors(calls).collect()}
    assert errors == {"a": (131006, "denied"), "b": (None, responses.UNREADABLE)}


def test_hot_parent_is_split(spark):
    """One parent holds most nodes: the partition of its children is divided among tasks."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("n"), "id").alias("node_token"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 500)).otherwise(F.lit("hot")).alias("parent_node_token"),
        F.col("id").alias("ord"),
    )
    parents = spark.range(500).select(
        F.concat(F.lit("p"), "id").alias("parent_key"), F.lit(1).alias("depth"), F.col("id").alias("place")
    ).union(spark.sql("SELECT 'hot', 1, 500L"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        placed = tree._placed(rows, parents)
        assert placed.count() == 200_000
        placed = placed.select("node_token", "parent_place")
        placed.collect()
        assert "skew=true" in placed._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
