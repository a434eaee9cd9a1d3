"""SQL expressions that mean the same in Spark and DuckDB: the rules by which the views of `views.py` and
of `oracle.py` are derived from the given tables. They go by the source of a document: what is true of one
source, such as that it was processed before, is true of all its documents."""

# Title of a document node, and its tokens.
TITLE = "lang || '/' || source || '/' || doc_id"
DOC_NODE = "'K' || doc_id"
DOC_OBJECT = "'D' || doc_id"
SECOND_NODE = "'X' || doc_id"
HAS_SECOND_NODE = "source IN ('src7', 'src12')"
UNTITLED = "source = 'src2'"

# What reading brings.
BLANK = "chr(32) || chr(9) || chr(10) || '　'"
IS_BLANK = "source = 'src4'"
ANSWERS_BY_NODE = "source = 'src5'"
ANSWERS_NOTHING = "source = 'src6'"
ANSWERS_NO_JSON = "source = 'src13'"
# Read before with another body, and exported twice.
READ_BEFORE = "source = 'src7'"
EXPORTED_TWICE = "source = 'src8'"
RESPONSE_CODE = f"CASE WHEN {ANSWERS_BY_NODE} OR {ANSWERS_NOTHING} THEN 1 ELSE 0 END"

LABELS = [
    "Science",
    "Science -> Physics",
    "Science -> Physics -> Optics",
    "Science -> Physics -> Optics -> Lens",
    "Science -> Physics -> Review",
    "Science -> Biology",
    "Science -> Legal",
    "Commerce",
    "Commerce -> Retail",
    "Commerce -> Retail -> Online",
    "Commerce -> Retail -> Review",
    "Commerce -> Finance",
    "Legal",
    "Services",
    "Others",
]

# Raw model answers, one per cleaning and matching rule. The model fails for one source.
FAILED = "source = 'src17'"
RAW_RESPONSE = """
    CASE source
        WHEN 'src0' THEN 'Science -> Physics -> Optics'
        WHEN 'src1' THEN '  Commerce -> Finance ' || chr(10)
        WHEN 'src2' THEN '```json' || chr(10) || 'Commerce -> Retail' || chr(10) || '```'
        WHEN 'src3' THEN '```' || chr(10) || 'Science -> Biology' || chr(10) || '```'
        WHEN 'src9' THEN '"Legal"'
        WHEN 'src10' THEN '分类结果：Commerce -> Retail -> Online'
        WHEN 'src11' THEN 'Services' || chr(10) || 'since the text is about services'
        WHEN 'src12' THEN 'Review'
        WHEN 'src13' THEN 'Science -> Physics -> Nope'
        WHEN 'src14' THEN 'Nope -> Online'
        WHEN 'src15' THEN 'science'
        WHEN 'src16' THEN ''
        WHEN 'src17' THEN NULL
        ELSE 'Science -> Physics -> Optics -> Lens'
    END
"""

CACHED_LABEL = "Commerce -> Retail"
IN_CACHE = "source IN ('src8', 'src14', 'src17', 'src18', 'src19')"
CACHED_BODY_IS_CURRENT = "source IN ('src8', 'src14')"
DONE_BEFORE = "source IN ('src3', 'src16')"
DOCUMENT_ROOT = "DOCS"
TARGET = "TARGET"
REQUEST_TEMPLATE = "Labels:\n{outline}\n\nText:\n{text}\n"
