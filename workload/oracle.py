"""The queries of `spark_queries.py` as DuckDB SQL over the same tables, written without regard to the Spark
code: closed forms and joins where that walks levels or stages tables."""

from __future__ import annotations

import re

from docgrove.functions.text import ANSWER_LABEL, TITLE_LABEL
from workload import rules

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}+|{WS}+\z', '', 'g')"


def _has_body(text: str) -> str:
    return rf"regexp_matches({text}, '[^\s\x0b\x1c-\x1f\x85\p{{Z}}]')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LABEL_ROWS = ", ".join(f"({n}, {_quoted(path)})" for n, path in enumerate(rules.LABELS))

# Views that the queries are written over; a query gets those it names.
VIEWS = {
    "tree_nodes": """
        SELECT 'R' || r_regionkey AS node_token, NULL AS parent_node_token, r_name AS title, 'docx' AS obj_type,
               'OR' || r_regionkey AS obj_token, true AS has_child, r_regionkey::BIGINT AS ord FROM region
        UNION ALL
        SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, 'docx', 'ON' || n_nationkey, true, n_nationkey FROM nation
        UNION ALL
        SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name, 'docx', 'OC' || c_custkey,
               c_custkey IN (SELECT o_custkey FROM orders), 2 * c_custkey FROM customer
        UNION ALL
        SELECT 'O' || o_orderkey, 'C' || o_custkey, o_orderstatus || ' ' || o_orderpriority, 'docx', 'OO' || o_orderkey,
               false, o_orderkey FROM orders
        UNION ALL
        SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, 'sheet', 'OS' || s_suppkey, false, 2 * s_suppkey + 1
        FROM supplier""",
    "docs": f"""
        SELECT doc_id, text, lang, source, {rules.TITLE} AS title, {rules.DOC_OBJECT} AS obj, {rules.DOC_NODE} AS node,
               min(doc_id) OVER (PARTITION BY lang) AS lang_ord, min(doc_id) OVER (PARTITION BY lang, source) AS source_ord,
               min(source) OVER (PARTITION BY lang) AS first_source
        FROM documents""",
    "first_sources": "SELECT DISTINCT lang, source_ord FROM docs WHERE source = first_source",
    "doc_places": f"""
        SELECT node AS node_token, 'S' || lang || '/' || source AS parent_node_token, obj AS obj_token, title, doc_id, source,
               lang, lang_ord, source_ord, doc_id AS ord, 'origin' AS node_type FROM docs
        UNION ALL
        SELECT 'X' || d.doc_id, 'S' || d.lang || '/' || d.first_source, d.obj, d.title, d.doc_id, d.source,
               d.lang, d.lang_ord, f.source_ord, 1000000000000000 + d.doc_id, 'shortcut'
        FROM docs d JOIN first_sources f ON f.lang = d.lang WHERE d.{rules.HAS_SECOND_NODE}""",
    "leaves": """
        SELECT *, coalesce(nullif(obj_token, ''), node_token) AS obj_key, 3 AS depth,
               (SELECT count(DISTINCT lang) FROM documents) + dense_rank() OVER (ORDER BY lang_ord, source_ord) AS parent_place
        FROM doc_places""",
    "doc_nodes": f"""
        SELECT '{rules.DOCUMENT_ROOT}' AS node_token, NULL AS parent_node_token, 'Documents' AS title, 'docx' AS obj_type,
               'ODOCS' AS obj_token, true AS has_child, 'origin' AS node_type, 0::BIGINT AS ord
        UNION ALL
        SELECT DISTINCT 'L' || lang, '{rules.DOCUMENT_ROOT}', lang, 'docx', 'OL' || lang, true, 'origin', lang_ord FROM docs
        UNION ALL
        SELECT DISTINCT 'S' || lang || '/' || source, 'L' || lang, source, 'docx', 'OS' || lang || '/' || source, true,
               'origin', source_ord FROM docs
        UNION ALL
        SELECT node_token, parent_node_token, title, 'docx', obj_token, false, node_type, ord FROM doc_places""",
    "listed": """
        SELECT *, row_number() OVER (PARTITION BY parent_node_token, ord % 1000000000000000 // 70 ORDER BY ord) - 1 AS pos,
               coalesce(parent_node_token = 'L' || (SELECT max(lang) FROM documents)
                        OR starts_with(parent_node_token, 'S' || (SELECT max(lang) FROM documents) || '/'), false) AS refused
        FROM doc_nodes""",
    "contents": f"""
        SELECT obj AS doc_id, 1 AS attempt, {rules.RESPONSE_CODE} AS code, {rules.ANSWERS_NO_JSON} AS broken,
               CASE WHEN {rules.IS_BLANK} THEN {rules.BLANK} WHEN ({rules.RESPONSE_CODE}) = 0 THEN text END AS content
        FROM docs CROSS JOIN range(2) AS copies(copy) WHERE copy = 0 OR {rules.EXPORTED_TWICE}
        UNION ALL
        SELECT node, 1, 0, {rules.ANSWERS_NO_JSON}, text FROM docs WHERE {rules.ANSWERS_BY_NODE}
        UNION ALL
        SELECT obj, 0, 0, {rules.ANSWERS_NO_JSON}, 'earlier ' || text FROM docs WHERE {rules.READ_BEFORE}""",
    "tokens": f"""
        SELECT node_token FROM doc_nodes UNION ALL SELECT node_token FROM tree_nodes
        UNION ALL SELECT {rules.DOC_OBJECT} FROM documents""",
    "infos": """
        SELECT node_token, obj_type, obj_token FROM doc_nodes
        UNION ALL SELECT node_token, obj_type, obj_token FROM tree_nodes""",
    "catalogue": """
        SELECT cast(min(p_partkey) AS VARCHAR) AS ord_path, p_brand AS path, NULL AS parent_path, 1 AS depth,
               false AS is_leaf, false AS listed, p_brand AS label FROM part GROUP BY p_brand
        UNION ALL
        SELECT b.k || '/' || min(p_partkey), p_brand || ' -> ' || p_type, p_brand, 2, false, false, p_type
        FROM part JOIN (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1) b USING (p_brand)
        GROUP BY b.k, p_brand, p_type
        UNION ALL
        SELECT b.k || '/' || t.k || '/' || min(p_partkey), p_brand || ' -> ' || p_type || ' -> size ' || p_size,
               p_brand || ' -> ' || p_type, 3, true, true, 'size ' || p_size
        FROM part JOIN (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY 1) b USING (p_brand)
                  JOIN (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2) t USING (p_brand, p_type)
        GROUP BY b.k, t.k, p_brand, p_type, p_size""",
    "outline": """
        SELECT ord_path, CASE depth WHEN 1 THEN '- ' || label || ':' ELSE '  - ' || label END AS line
        FROM catalogue WHERE depth < 3
        UNION ALL
        SELECT arg_min(ord_path, split_part(ord_path, '/', 3)::BIGINT),
               '      ' || string_agg(label, '、' ORDER BY split_part(ord_path, '/', 3)::BIGINT)
        FROM catalogue WHERE depth = 3 GROUP BY parent_path""",
    "labels": f"SELECT * FROM (VALUES {_LABEL_ROWS}) AS t(ord, path)",
    "raw": f"""
        SELECT obj AS obj_key, doc_id, {rules.RAW_RESPONSE} AS raw_response,
               CASE WHEN {rules.FAILED} THEN 'RuntimeError: no answer' END AS error FROM docs""",
    "clean1": f"""
        SELECT obj_key, error, raw_response,
               regexp_replace(regexp_replace(regexp_replace({_strip("coalesce(raw_response, '')")},
                   '\\A```json', ''), '\\A```', ''), '```\\z', '') AS a FROM raw""",
    "clean2": f"""
        SELECT obj_key, error, raw_response,
               regexp_replace(regexp_replace({_strip("a")}, '\\A"+|"+\\z', '', 'g'), '\\A''+|''+\\z', '', 'g') AS a
        FROM clean1""",
    "clean3": f"""
        SELECT obj_key, error, raw_response, CASE WHEN starts_with(a, '{ANSWER_LABEL}')
               THEN {_strip(f"replace(a, '{ANSWER_LABEL}', '')")} ELSE a END AS a FROM clean2""",
    "cleaned": f"""
        SELECT obj_key, error, raw_response,
               CASE WHEN contains(a, chr(10)) THEN {_strip("split_part(a, chr(10), 1)")} ELSE a END AS answer FROM clean3""",
    "answers": "SELECT DISTINCT answer FROM cleaned WHERE error IS NULL",
    "matches": """
        SELECT answer, ord, path,
               CASE WHEN path = answer THEN 0 WHEN contains(path, answer) OR contains(answer, path) THEN 1
                    WHEN path = string_split(answer, ' -> ')[-1]
                         OR ends_with(path, ' -> ' || string_split(answer, ' -> ')[-1]) THEN 2 END AS tier
        FROM answers, labels WHERE answer <> ''""",
    "verdicts": """
        SELECT a.answer, CASE WHEN a.answer = 'Others' THEN 'Others'
                              ELSE coalesce(arg_min(m.path, m.tier * 1000000 + m.ord), 'Others') END AS path,
               CASE WHEN a.answer = 'Others' THEN 0 ELSE coalesce(min(m.tier), 3) END AS match_tier
        FROM answers a LEFT JOIN matches m ON m.answer = a.answer AND m.tier IS NOT NULL GROUP BY a.answer""",
    "labelled": """
        SELECT c.obj_key, c.raw_response, c.error, CASE WHEN c.error IS NULL THEN c.answer END AS answer, v.path, v.match_tier
        FROM cleaned c LEFT JOIN verdicts v ON c.error IS NULL AND v.answer = c.answer""",
    "routes": """
        SELECT *, string_split(path, ' -> ') AS parts, string_split(path, ' -> ')[1] AS tag1,
               string_split(path, ' -> ')[2] AS tag2, string_split(path, ' -> ')[3] AS tag3,
               string_split(path, ' -> ')[4] AS tag4 FROM labelled WHERE error IS NULL""",
    "pending": f"""
        SELECT * FROM leaves WHERE node_token NOT IN (SELECT {rules.DOC_NODE} FROM documents WHERE {rules.DONE_BEFORE})""",
    "last_places": """
        SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY obj_key ORDER BY depth DESC, lang_ord DESC, source_ord DESC, ord DESC) AS place FROM pending)
        WHERE place = 1""",
    "last_leaves": """
        SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY obj_key ORDER BY depth DESC, lang_ord DESC, source_ord DESC, ord DESC) AS place FROM leaves)
        WHERE place = 1""",
    "ok_responses": f"SELECT *, {_has_body('content')} AS has_body FROM contents WHERE code = 0 "
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempt DESC) = 1",
    "reads": """
        SELECT p.obj_key, p.node_token, p.title, p.obj_token, p.source,
               CASE WHEN r1.doc_id IS NOT NULL THEN r1.doc_id ELSE r2.doc_id END AS response_id,
               CASE WHEN r1.doc_id IS NOT NULL THEN r1.has_body ELSE r2.has_body END AS has_body,
               CASE WHEN r1.doc_id IS NOT NULL THEN r1.content ELSE r2.content END AS content
        FROM last_places p LEFT JOIN ok_responses r1 ON r1.doc_id = p.obj_key
                           LEFT JOIN ok_responses r2 ON r2.doc_id = p.node_token""",
    "status": f"""
        SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN has_body THEN 'ok' ELSE 'empty' END AS read_status,
               CASE WHEN has_body AND {rules.CACHED_BODY_IS_CURRENT} THEN '{rules.CACHED_LABEL}' END AS cached_path,
               CASE WHEN has_body THEN sha256(content) END AS content_hash FROM reads""",
    "outcomes": """
        SELECT s.*, coalesce(s.cached_path, CASE WHEN s.read_status = 'ok' THEN l.path END) AS path,
               CASE WHEN s.cached_path IS NULL AND s.read_status = 'ok' THEN l.match_tier END AS match_tier,
               CASE WHEN s.read_status <> 'ok' THEN 'empty'
                    WHEN coalesce(s.cached_path, l.path) IS NOT NULL THEN 'success' ELSE 'failed' END AS status
        FROM status s LEFT JOIN labelled l ON l.obj_key = s.obj_key""",
    "level1": f"""
        SELECT DISTINCT split_part(path, ' -> ', 1) AS path, CASE WHEN split_part(path, ' -> ', 1) = 'Science' THEN 'T2'
               ELSE sha256('{rules.TARGET}/' || split_part(path, ' -> ', 1)) END AS token FROM wanted""",
    "level2": """
        SELECT DISTINCT t[1] || ' -> ' || t[2] AS path, l.path AS parent, l.token AS parent_token, t[2] AS title,
               CASE WHEN l.token = 'T2' AND t[2] = 'Physics' THEN 'T3' ELSE sha256(l.token || '/' || t[2]) END AS token
        FROM (SELECT string_split(path, ' -> ') AS t FROM wanted) JOIN level1 l ON l.path = t[1] WHERE len(t) > 1""",
    "level3": """
        SELECT DISTINCT l.path || ' -> ' || t[3] AS path, l.token AS parent_token, t[3] AS title,
               sha256(l.token || '/' || t[3]) AS token
        FROM (SELECT string_split(path, ' -> ') AS t FROM wanted) JOIN level2 l ON l.path = t[1] || ' -> ' || t[2]
        WHERE len(t) > 2""",
    "folders": f"""
        SELECT 1 AS level, path, '{rules.TARGET}' AS parent_token, path AS title, token AS node_token,
               token <> 'T2' AS created FROM level1
        UNION ALL SELECT 2, path, parent_token, title, token, token <> 'T3' FROM level2
        UNION ALL SELECT 3, path, parent_token, title, token, true FROM level3""",
    "routed": """
        SELECT o.*, f.node_token AS target_parent, string_split(o.path, ' -> ')[1] AS tag1,
               string_split(o.path, ' -> ')[2] AS tag2, string_split(o.path, ' -> ')[3] AS tag3,
               '| Tag1: ' || string_split(o.path, ' -> ')[1]
                   || coalesce(' | Tag2: ' || string_split(o.path, ' -> ')[2], '')
                   || coalesce(' | Tag3: ' || string_split(o.path, ' -> ')[3], '')
                   || coalesce(' | Tag4: ' || string_split(o.path, ' -> ')[4], '') AS tag_line
        FROM outcomes o JOIN folders f ON f.path = CASE WHEN len(string_split(o.path, ' -> ')) > 3
            THEN array_to_string(string_split(o.path, ' -> ')[1:3], ' -> ') ELSE o.path END
        WHERE o.status = 'success'""",
    "titled": f"SELECT obj AS obj_key, CASE WHEN {rules.UNTITLED} THEN '' ELSE title END AS title, text FROM docs",
    "prepared": f"""
        SELECT obj_key, CASE WHEN title <> '' THEN '{TITLE_LABEL}' || title || chr(10) || chr(10) ELSE '' END AS head, text
        FROM titled""",
}

_WALK = """
    WITH RECURSIVE walked AS (
        SELECT n.node_token, n.parent_node_token, n.title, n.ord, n.has_child, 1 AS depth, [n.ord] AS path
        FROM tree_nodes n WHERE {start}
        UNION ALL
        SELECT n.node_token, n.parent_node_token, n.title, n.ord, n.has_child, w.depth + 1, list_append(w.path, n.ord)
        FROM tree_nodes n JOIN walked w ON n.parent_node_token = w.node_token WHERE w.has_child
    ), expanded AS (
        SELECT node_token, row_number() OVER (ORDER BY depth, path, node_token) AS place FROM walked WHERE has_child
    )
"""
_WALKED = """ w.node_token, w.parent_node_token, w.title, w.depth, coalesce(e.place, 0) AS parent_place, w.ord
    FROM walked w LEFT JOIN expanded e ON e.node_token = w.parent_node_token"""
_ALL = "n.parent_node_token IS NULL"

QUERIES = {
    "ingest_listing": """SELECT node_token, parent_node_token, title, obj_type, obj_token, has_child, node_type,
        (ord % 1000000000000000 // 70) * 4294967296 + pos AS ord FROM listed WHERE NOT refused""",
    "ingest_listing_errors": """SELECT DISTINCT parent_node_token, ord % 1000000000000000 // 70 AS page, 1 AS code, 'denied' AS msg
        FROM listed WHERE refused""",
    "ingest_content": f"""SELECT doc_id, CASE WHEN NOT broken THEN code END AS code,
            CASE WHEN broken THEN 'body is not JSON' WHEN code = 0 THEN 'success' ELSE 'not found' END AS msg,
            CASE WHEN NOT broken AND {_has_body("content")} THEN length(content) END AS n_chars,
            CASE WHEN NOT broken AND {_has_body("content")} THEN sha256(content) END AS content_hash
        FROM contents""",
    "doc_title": f"""SELECT n.node_token, n.obj_token AS doc_id, CASE WHEN NOT (d.{rules.ANSWERS_NOTHING}) THEN d.title END AS title
        FROM doc_nodes n LEFT JOIN docs d ON d.obj = n.obj_token""",
    "resolve_strict": """SELECT t.node_token, CASE WHEN i.obj_type = 'docx' THEN i.obj_token END AS document_id
        FROM tokens t LEFT JOIN infos i ON i.node_token = t.node_token""",
    "resolve_lenient": """SELECT t.node_token, CASE WHEN i.node_token IS NULL THEN t.node_token
        WHEN i.obj_type = 'docx' THEN i.obj_token END AS document_id
        FROM tokens t LEFT JOIN infos i ON i.node_token = t.node_token""",
    "taxonomy_paths": "SELECT ord_path, path, parent_path, depth, is_leaf, listed FROM catalogue",
    "taxonomy_json": """WITH brands AS (
            SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS b FROM part GROUP BY p_brand),
        types AS (
            SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS t
            FROM part GROUP BY p_brand, p_type),
        sizes AS (
            SELECT p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY min(p_partkey)) - 1 AS s
            FROM part GROUP BY p_brand, p_type, p_size)
        SELECT cast(b AS VARCHAR) AS ord_path, p_brand AS path, NULL AS parent_path, 1 AS depth, false AS is_leaf, false AS listed
        FROM brands
        UNION ALL SELECT b || '/' || t, p_brand || ' -> ' || p_type, p_brand, 2, false, false FROM types JOIN brands USING (p_brand)
        UNION ALL SELECT b || '/' || t || '/' || s, p_brand || ' -> ' || p_type || ' -> size ' || p_size,
            p_brand || ' -> ' || p_type, 3, true, true
        FROM sizes JOIN types USING (p_brand, p_type) JOIN brands USING (p_brand)""",
    "tree_walk": _WALK.format(start="n.parent_node_token = 'R1'") + "SELECT" + _WALKED,
    "tree_walk_all": _WALK.format(start=_ALL) + "SELECT" + _WALKED,
    "tree_walk_space": (_WALK.format(start=_ALL) + "SELECT" + _WALKED).replace("tree_nodes", "doc_nodes"),
    "bfs_order": """SELECT node_token, obj_token, title, depth, parent_place, ord FROM leaves
        ORDER BY lang_ord, source_ord, ord""",
    "leaf_docs": "SELECT node_token, obj_token, title FROM tree_nodes WHERE obj_type = 'docx' AND NOT has_child",
    "scan_stats": """SELECT count(*) FILTER (obj_type = 'docx' AND NOT has_child) AS documents_found,
        count(*) FILTER (obj_type = 'docx' AND has_child) AS non_leaf_docx_skipped, count(*) AS nodes_reached,
        count(*) FILTER (has_child) + 1 AS nodes_expanded FROM tree_nodes""",
    "find_by_title": """SELECT 'K' || min(doc_id) AS node_token FROM documents WHERE lang = 'en' AND source = 'src7'""",
    "resolve_root": """SELECT 'scan by token' AS choice, 'K5' AS node_token
        UNION ALL SELECT 'scan by name', 'K' || min(doc_id) FROM documents WHERE lang = 'en' AND source = 'src7'
        UNION ALL SELECT 'target by name', 'K' || min(doc_id) FROM documents WHERE lang = 'de' AND source = 'src3'
        UNION ALL SELECT 'target by fallback name', coalesce('K' || min(doc_id), 'fr/src1')
            FROM documents WHERE lang = 'fr' AND source = 'src1'
        UNION ALL SELECT 'target by fallback token', 'Fb123' UNION ALL SELECT 'target nowhere', NULL""",
    "node_upsert": """SELECT node_token, parent_node_token, CASE WHEN renewed THEN title ELSE 'old ' || title END AS title,
        has_child, CASE WHEN renewed THEN 2 ELSE 1 END AS scan_month
        FROM (SELECT *, coalesce(parent_node_token = 'Len' OR starts_with(parent_node_token, 'Sen/'), false) AS renewed
              FROM doc_nodes)""",
    "scan_snapshot": """SELECT node_token, obj_token, title, 2 AS depth, dense_rank() OVER (ORDER BY source_ord) AS parent_place, ord
        FROM leaves WHERE lang = 'en'""",
    "child_map": """SELECT coalesce(parent_node_token, '') AS parent_key, title, arg_max(node_token, ord) AS node_token
        FROM tree_nodes GROUP BY 1, 2""",
    "duplicate_titles": """SELECT coalesce(parent_node_token, '') AS parent_key, title, count(*) AS occurrences,
        arg_max(node_token, ord) AS node_token
        FROM (SELECT parent_node_token, title, node_token, ord FROM tree_nodes
              UNION ALL SELECT parent_node_token, title, node_token, ord FROM doc_nodes)
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "name_check": """SELECT 'S' || d.lang || '/src0' AS parent_key, d.title, count(p.node_token) > 0 AS is_duplicate,
            arg_max(p.node_token, p.ord) AS node_token, count(p.node_token) AS occurrences
        FROM docs d LEFT JOIN doc_places p ON p.parent_node_token = 'S' || d.lang || '/src0' AND p.title = d.title
        GROUP BY d.lang, d.title""",
    "title_counts": """SELECT coalesce(parent_node_token, '') AS parent_key, count(DISTINCT title) AS total_count
        FROM (SELECT parent_node_token, title FROM tree_nodes UNION ALL SELECT parent_node_token, title FROM doc_nodes)
        GROUP BY 1""",
    "nonblank_docs": f"SELECT doc_id, length(content) AS n_chars FROM contents WHERE {_has_body('content')}",
    "limit_then_pending": f"""SELECT node_token, obj_token, depth, parent_place, ord
        FROM (SELECT * FROM leaves ORDER BY lang_ord, source_ord, ord LIMIT 100)
        WHERE node_token NOT IN (SELECT {rules.DOC_NODE} FROM documents WHERE {rules.DONE_BEFORE})""",
    "pending_docs": "SELECT node_token, obj_token, title, depth, parent_place, ord FROM pending",
    "dedupe_obj": "SELECT obj_key, node_token, title FROM last_leaves",
    "read_contents": """SELECT obj_key, node_token, title, response_id, read_status, content_hash,
        CASE WHEN has_body THEN sha256(content) END AS body_hash, CASE WHEN has_body THEN length(content) END AS n_chars
        FROM status""",
    "content_parts": """SELECT obj_key, node_token, response_id, sha256(content) AS body_hash FROM status
        WHERE read_status = 'ok'""",
    "read_summary": """SELECT count(*) AS total, count(*) FILTER (coalesce(body, false)) AS ok,
            count(*) FILTER (NOT coalesce(body, false)) AS empty, count(*) FILTER (body IS NULL) AS missing
        FROM (SELECT CASE WHEN r1.doc_id IS NOT NULL THEN r1.has_body ELSE r2.has_body END AS body
              FROM pending p LEFT JOIN ok_responses r1 ON r1.doc_id = p.obj_key
                             LEFT JOIN ok_responses r2 ON r2.doc_id = p.node_token)""",
    "content_hash": "SELECT doc_id, sha256(coalesce(content, '')) AS content_hash FROM contents",
    "cache_lookup": "SELECT obj_key, node_token, read_status, cached_path FROM status",
    "cache_import": """SELECT obj_key AS obj_token, path, '{' || array_to_string(list_transform(
            parts, lambda p, i: '"tag' || i || '":["' || p || '"]'), ',') || '}' AS tag_json, 10 AS updated_hour
        FROM routes""",
    "cache_upsert": f"""SELECT obj AS obj_token,
            CASE WHEN l.error IS NOT NULL AND NOT ({rules.CACHED_BODY_IS_CURRENT}) THEN sha256(text || '!')
                 ELSE sha256(text) END AS content_hash,
            CASE WHEN l.error IS NULL THEN l.path ELSE '{rules.CACHED_LABEL}' END AS path,
            '{{' || array_to_string(list_transform(
                string_split(CASE WHEN l.error IS NULL THEN l.path ELSE '{rules.CACHED_LABEL}' END, ' -> '),
                lambda p, i: '"tag' || i || '":["' || p || '"]'), ',') || '}}' AS tag_json,
            CASE WHEN l.error IS NULL THEN 2 ELSE 1 END AS updated_month
        FROM docs d JOIN labelled l ON l.obj_key = d.obj WHERE l.error IS NULL OR {rules.IN_CACHE}""",
    "prepare_text": f"""SELECT obj_key, length(head || text) AS n_chars, sha256(head || text) AS text_hash FROM prepared""",
    "taxonomy_outline": "SELECT ord_path, line FROM outline",
    "prompt_len": """SELECT obj_key, length(head || text) + length('Labels:') + length('Text:') + 5
        + (SELECT sum(length(line)) + count(*) - 1 FROM outline)::BIGINT AS n_chars FROM prepared""",
    "classify_stub": "SELECT obj_key, raw_response, error, path, match_tier FROM labelled",
    "clean_response": "SELECT obj_key, raw_response, answer FROM cleaned",
    "validate_path": """SELECT answer, path, match_tier, count(*) AS documents FROM labelled
        GROUP BY answer, path, match_tier""",
    "path_to_tags": """SELECT obj_key, len(parts)::INTEGER AS levels, '{' || array_to_string(list_transform(
            parts, lambda p, i: '"tag' || i || '":["' || p || '"]'), ',') || '}' AS tag_json,
        tag1, tag2, tag3, tag4 FROM routes""",
    "taxonomy_roots": "SELECT ord_path, path FROM catalogue WHERE depth = 1",
    "taxonomy_search": "SELECT ord_path, path FROM catalogue WHERE lower(path) LIKE '%size 1%'",
    "taxonomy_stats": """SELECT count(*) AS n_paths, count(*) FILTER (depth = 1) AS n_roots,
        count(*) FILTER (is_leaf) AS n_leaves, max(depth) AS max_depth FROM catalogue""",
    "route_paths": """SELECT obj_key, path, len(parts)::INTEGER AS levels, least(len(parts), 3)::INTEGER AS folder_levels,
        tag1, tag2, tag3 FROM routes""",
    "folder_plan": "SELECT level, path, parent_token, title, node_token, created FROM folders",
    "new_folders": """SELECT node_token, parent_token AS parent_node_token, title, 'docx' AS obj_type,
        'origin' AS node_type FROM folders WHERE created""",
    "routed_docs": """SELECT node_token, obj_token, title, target_parent, tag1, tag2, tag3, sha256(content) AS body_hash
        FROM routed""",
    "tag_message": """SELECT obj_key, chr(10) || ' | ' || array_to_string(list_transform(
        parts, lambda p, i: 'Tag' || i || ': ' || p), ' | ') AS message FROM routes""",
    "annotated_docs": """SELECT obj_token, tag_line, sha256(tag_line || chr(10) || content) AS annotated_hash FROM routed""",
    "ledger_append": f"""SELECT {rules.DOC_NODE} AS node_token, '{rules.DOCUMENT_ROOT}' AS scan_root,
            '{rules.TARGET}' AS target_root, 1 AS processed_month FROM documents WHERE {rules.DONE_BEFORE}
        UNION ALL
        SELECT node_token, '{rules.DOCUMENT_ROOT}', '{rules.TARGET}', 2 FROM outcomes WHERE status = 'success'""",
    "ledger_load": f"""SELECT 'same root' AS choice, {rules.DOC_NODE} AS node_token FROM documents
        WHERE {rules.DONE_BEFORE}""",
    "ledger_import": f"""SELECT {rules.DOC_NODE} AS node_token, '{rules.DOCUMENT_ROOT}' AS scan_root,
            '{rules.TARGET}' AS target_root, CASE WHEN doc_id % 10 = 7 THEN 4 ELSE 3 END AS processed_month
        FROM documents WHERE {rules.DONE_BEFORE}""",
    "classify_stats": """SELECT count(*) FILTER (read_status = 'ok') AS total,
        count(*) FILTER (read_status = 'ok' AND path IS NOT NULL) AS ok,
        count(*) FILTER (read_status = 'ok' AND path IS NULL) AS failed,
        count(cached_path) AS cached, count(*) FILTER (read_status <> 'ok') AS empty FROM outcomes""",
    "run_stats": """SELECT (SELECT count(*) FROM leaves) AS found,
            (SELECT count(*) FROM doc_nodes WHERE has_child AND parent_node_token IS NOT NULL) AS non_leaf_docx_skipped,
            count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
            (SELECT count(*) FROM leaves) - (SELECT count(*) FROM pending) + count(*) FILTER (status = 'empty') AS skipped,
            count(*) FILTER (status = 'empty') AS empty,
            round(count(*) FILTER (status = 'success') * 100.0::DOUBLE
                / nullif(count(*) FILTER (status IN ('success', 'failed')), 0), 1) AS success_rate
        FROM outcomes""",
    "end_to_end": """SELECT o.obj_key, o.node_token, o.read_status, o.cached_path IS NOT NULL AS cached, o.path,
            o.match_tier, o.status, r.target_parent, r.tag_line,
            sha256(r.tag_line || chr(10) || r.content) AS annotated_hash
        FROM outcomes o LEFT JOIN routed r ON r.node_token = o.node_token""",
}

# Which paths a query makes folders for.
WANTED = {"folder_plan": "routes", "new_folders": "routes"}


def _views(sql: str, found: dict[str, str], wanted: str) -> dict[str, str]:
    """The views that `sql` names, after the views those name."""
    for name, body in (VIEWS | {"wanted": f"SELECT path FROM {wanted} WHERE path IS NOT NULL"}).items():
        if name not in found and re.search(rf"\b(FROM|JOIN|,) {name}\b", sql):
            _views(body, found, wanted)
            found[name] = body
    return found


def sql(name: str) -> str:
    body = QUERIES[name]
    views = _views(body, {}, WANTED.get(name, "(SELECT * FROM outcomes WHERE status = 'success')"))
    heads = [f"{view} AS ({text})" for view, text in views.items()]
    if not heads:
        return body
    if "WITH RECURSIVE" in body:
        return body.replace("WITH RECURSIVE", "WITH RECURSIVE " + ", ".join(heads) + ",", 1)
    return "WITH " + ", ".join(heads) + " " + body
