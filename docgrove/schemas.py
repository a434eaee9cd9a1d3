"""Table layouts, as DDL strings, of everything the engine reads and writes."""

# Children of one parent as a listing call returns them.
LISTING_BODY = """
    code INT, msg STRING,
    data STRUCT<
        items: ARRAY<STRUCT<node_token: STRING, title: STRING, obj_type: STRING, obj_token: STRING,
                            has_child: BOOLEAN, node_type: STRING, url: STRING>>,
        has_more: BOOLEAN, page_token: STRING>
"""
CONTENT_BODY = "code INT, msg STRING, data STRUCT<content: STRING>"
DOCUMENT_BODY = "code INT, msg STRING, data STRUCT<document: STRUCT<title: STRING>>"
NODE_BODY = "code INT, msg STRING, data STRUCT<node: STRUCT<obj_token: STRING, obj_type: STRING>>"

# Exported responses, one JSON body per call, with the arguments of the call beside it. `attempt` tells repeated calls
# apart, the newest has the greatest; an export without it has one response per call.
LISTING_RESPONSES = "parent_node_token STRING, page BIGINT, body STRING"
DOCUMENT_RESPONSES = "doc_id STRING, attempt BIGINT, body STRING"
NODE_RESPONSES = "node_token STRING, attempt BIGINT, body STRING"

# `ord` orders a node among its siblings as they were listed.
NODES = """
    node_token STRING, parent_node_token STRING, title STRING, obj_type STRING, obj_token STRING,
    has_child BOOLEAN, node_type STRING, url STRING, ord BIGINT
"""
# `content_hash` is optional; it is null for a blank body.
CONTENTS = "doc_id STRING, attempt BIGINT, code INT, msg STRING, content STRING, content_hash STRING"

# `ord_path` sorts labels in depth-first pre-order; `listed` marks items of a JSON list.
TAXONOMY = """
    ord_path ARRAY<BIGINT>, path STRING, parts ARRAY<STRING>, parent_path STRING,
    depth INT, is_leaf BOOLEAN, listed BOOLEAN
"""

ANSWERS = "obj_key STRING, raw_response STRING, error STRING"
CACHE = """
    obj_token STRING, content_hash STRING, taxonomy_version STRING, path STRING,
    tag_json STRING, updated_at TIMESTAMP
"""
NODE_SNAPSHOT = """
    node_token STRING, parent_node_token STRING, title STRING, obj_type STRING,
    has_child BOOLEAN, node_type STRING, scan_time TIMESTAMP
"""
LEDGER = "node_token STRING, scan_root STRING, target_root STRING, processed_at TIMESTAMP"

# State as the reference keeps it, to start from.
PROGRESS = """
    processed_tokens ARRAY<STRING>, total_processed INT, last_update STRING, scan_root STRING, target_root STRING
"""
TAG_CACHE = "obj_token STRING, content_hash STRING, tag_json STRING, updated_at STRING"

# The label columns are partitions and stay text, even if a label looks like a number.
ROUTED = """
    node_token STRING, obj_token STRING, title STRING, target_parent STRING, tag_line STRING, content STRING,
    tag1 STRING, tag2 STRING, tag3 STRING
"""
ANNOTATED = "node_token STRING, obj_token STRING, title STRING, tag_line STRING, annotated_content STRING"
