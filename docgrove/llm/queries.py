"""The registered queries of this folder over the given tables, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgrove.llm import ann_crosspolytope, html_wrappers, media_wav, pii_semicrf, ranked_search, secret_scan, source_divergence, source_mixing
from docgrove.llm.byte_shards import byte_shards
from docgrove.llm.harmonic_packing import pack
from docgrove.llm.jaccard_join import jaccard_components
from docgrove.llm.quality_ftrl import quality_scores
from docgrove.llm.tables import read_table
from docgrove.llm.toxicity_zstd import toxicity_scores


def op1_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.find(read_table(spark, sf_dir, "documents"))


def op2_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op4_media_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_wav.digests(media_wav.media_columns(read_table(spark, sf_dir, "documents")))


def op5_toxicity_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_ann_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann_crosspolytope.nearest(vectors, F.col("vec_id") % 20 == 0)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(read_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    levels = source_mixing.document_levels()
    mixed = source_mixing.mix(docs, levels, source_mixing.document_weights())
    named = [F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()]
    return mixed.select("doc_id", *named, "epoch", source_mixing.token_count(F.col("text")).alias("tokens"))


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(read_table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii_semicrf": op1_pii_semicrf,
    "op2_quality_ftrl": op2_quality_ftrl,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_media_wav": op4_media_wav,
    "op5_toxicity_zstd": op5_toxicity_zstd,
    "op6_ann_crosspolytope": op6_ann_crosspolytope,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_byte_shards": op8_byte_shards,
    "op9_source_mixing": op9_source_mixing,
    "op10_html_wrappers": op10_html_wrappers,
    "op11_source_divergence": op11_source_divergence,
    "op12_secret_scan": op12_secret_scan,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE: dict[str, str] = {}

ORACLE["op3_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words),
every AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM sets),
grams AS (SELECT * FROM every WHERE gram IN (SELECT gram FROM every GROUP BY gram HAVING count(*) > 1)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.g
"""

_BUDGET_LEVEL = """
{name}_n AS (
  SELECT {parent}, {node}, max({w}) AS w, sum(cap)::HUGEINT AS c FROM tree GROUP BY ALL),
{name}_f AS (
  SELECT n.*, g.given::HUGEINT AS given,
    coalesce(sum(c) OVER (PARTITION BY {np} ORDER BY c / w, n.{node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (PARTITION BY {np} ORDER BY c / w, n.{node} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM {name}_n n JOIN {above} g USING ({parent})),
{name}_s AS (
  SELECT *, c * rest <= (given - before) * w AS full_ FROM {name}_f),
{name}_o AS (
  SELECT *, given - sum(CASE WHEN full_ THEN c ELSE 0 END) OVER (PARTITION BY {parent}) AS left_,
    sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent}) AS open,
    sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {parent} ORDER BY {node}) AS sums
  FROM {name}_s),
{name} AS (
  SELECT {parent}, {node}, CASE WHEN full_ THEN c WHEN open > 0 THEN left_ * sums // open - left_ * (sums - w) // open ELSE 0 END AS given
  FROM {name}_o)"""

_LEVELS = [
    ("by_domain", "root", "domain", "w0", "top"),
    ("by_lang", "root, domain", "lang", "w1", "by_domain"),
    ("by_source", "root, domain, lang", "source", "w2", "by_lang"),
]


def _weights(column: str, values: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {source_mixing.OTHER_WEIGHT} END"


ORACLE["op9_source_mixing"] = rf"""
WITH docs AS (
  SELECT doc_id, coalesce('domain' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4), '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
tree AS (
  SELECT 0 AS root, *, {_weights("domain", source_mixing.DOMAIN_WEIGHTS)} AS w0, {_weights("lang", source_mixing.LANG_WEIGHTS)} AS w1, 1 AS w2,
    {source_mixing.MAX_EPOCHS} * tokens AS cap
  FROM leaves),
top AS (SELECT 0 AS root, least(sum(tokens), sum(cap)) AS given FROM tree),
{",".join(_BUDGET_LEVEL.format(name=a, parent=b, np=", ".join("n." + x.strip() for x in b.split(",")), node=c, w=d, above=e) for a, b, c, d, e in _LEVELS)},
plan AS (
  SELECT l.*, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM by_source b JOIN leaves l USING (domain, lang, source)),
placed AS (
  SELECT d.*, p.epochs, p.rest,
    md5('{source_mixing.SEED}:' || p.epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5) AS place
  FROM docs d JOIN plan p USING (domain, lang, source)),
taken AS (
  SELECT *, epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) <= rest THEN 1 ELSE 0 END AS times
  FROM placed)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS INTEGER) AS epoch FROM taken
"""

ORACLE["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(CASE WHEN text IS NULL THEN [''] ELSE [text] END) AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT r) AS d FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY ALL HAVING sum(d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, k.c AS whole
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n FROM cells),
shares AS (
  SELECT s.lang, s.source, s.term, s.c, 1 + (1000000000 * (s.c + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000 * (s.whole + 2)) // (l.n + 2 * l.v) AS q
  FROM sized s JOIN langs l USING (lang)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM shares WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE["op13_ranked_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT i, item_id, term, count(*) AS times FROM items GROUP BY ALL),
whole AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM docs WHERE len(w) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * whole.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, whole GROUP BY term, whole.n),
scored AS (
  SELECT i, item_id, r, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * tf.n * whole.n) // whole.l)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
