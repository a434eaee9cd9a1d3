"""Source divergence, secret scan and ranked search against brute force and DuckDB, on rows with nulls, empty and very long
texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrove.llm import queries, ranked_search, secret_scan, source_divergence
from docgrove.llm.terms import term_codes
from docgrove.llm.words import text_column

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_ranked_search"])
def test_queries_equal_duckdb(spark, sf, duck, name):
    ours = queries.QUERIES[name](spark, sf)
    theirs = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in theirs.description]
    assert rows_of(ours.select(columns)) == sorted(theirs.fetchall(), key=repr)


@pytest.mark.parametrize("digits, pattern", [(False, LETTERS), (True, TERMS)])
@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_terms_are_those_of_the_pattern(digits, pattern, size):
    texts = ["", None, "Ab1c-É9[x]`y{z}", "日本 語X", "a", "A" * 200, "x\x00y\x7fz@", "é", "9", " a b ", "ß.ẞ"]
    found = {}
    for row, counts, codes, distinct in term_codes(text_column(pa.array(texts, pa.string())), digits, size):
        names, at = [x.decode() for x in distinct.to_pylist()], 0
        for i, n in enumerate(counts.tolist()):
            found[row + i] = [names[c] for c in codes[at : at + n].tolist()]
            at += n
    assert [found[i] for i in range(len(texts))] == [[w.translate(LOWER) for w in pattern.findall(t or "")] for t in texts]


# Source divergence


def brute_divergence(rows, least, top):
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in LETTERS.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w in df if df[w] >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(words)
            counts[None].update(words)
        share = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept} for s, c in counts.items()}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in {d[1] for d in own}:
            share.setdefault(s, {})
            pairs = [(sum(apart(share[s][w], share[t][w]) for w in kept), t) for t in {d[1] for d in own} - {s}]
            terms = [(apart(share[s][w], share[None][w]), w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def sourced(spark):
    pick = random.Random(7)
    words = ["".join(pick.choice("abcdeé日") for _ in range(pick.randint(1, 3))) for _ in range(150)]
    rows = []
    for i in range(260):
        lang, source = pick.choice(["en", "en", "de", None]), f"s{pick.choice([0, 0, 0, 1, 2, 3])}"
        text = " ".join(pick.choice(words[:60] if source == "s0" else words) for _ in range(pick.randint(0, 60))).title()
        rows.append((lang, source, text))
    rows += [("en", None, None), ("en", None, ""), ("en", "only", "1 2 3"), ("xx", "alone", "one"), ("en", "s1", "long " * 60000), ("fr", "a", "x"), ("fr", "b", "y")]
    rows += rows[:20]
    return rows


def as_docs(spark, rows):
    extra = [(lang, source, text, 1, "x", 2.0) for lang, source, text in rows]
    return spark.createDataFrame(extra, "lang string, source string, text string, rank int, item string, value double")


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, sourced, monkeypatch, small):
    """Also with blocks, chunks, merges and slices so small that every way is taken."""
    if small:
        for name, value in (("BLOCK_BYTES", 3000), ("SLICE_BYTES", 500), ("CHUNK", 7), ("MERGE", 20), ("SLICE_POSTINGS", 50), ("PAIRS", 10)):
            monkeypatch.setattr(source_divergence, name, value)
    docs = as_docs(spark, sourced).repartition(3)
    found = source_divergence.divergence(docs, least_docs=5, top=4)
    assert rows_of(found.select("lang", "source", "part", "item", "value", "rank")) == brute_divergence(sourced, 5, 4)


def test_small_limits_reach_the_same_runs(sourced, monkeypatch):
    """A block of a few postings spills many runs; merged, they are the postings of one block."""
    texts = text_column(pa.array([r[2] for r in sourced], pa.string()))
    names = [(r[0] or "", r[1] or "") for r in sourced]

    def postings():
        block = source_divergence._Block(3)
        batches = [*block.add(names, texts), *block.spill()]
        found = Counter()
        for batch in batches:
            for row in batch.to_pylist():
                assert row["terms"] == sorted(row["terms"]) and row["first"] == row["terms"][0] and row["last"] == row["terms"][-1]
                for term, source, tf, df in zip(row["terms"], row["sources"], row["tf"], row["df"]):
                    found[row["lang"], term, source, "tf"] += tf
                    found[row["lang"], term, source, "df"] += df
        return len(batches), found

    few, whole = postings()
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", 200)
    many, parts = postings()
    assert many > few and parts == whole


def test_divergence_of_empty_tables(spark, no_docs):
    assert source_divergence.divergence(no_docs).count() == 0
    assert rows_of(source_divergence.divergence(as_docs(spark, [("en", "a", None), ("en", "b", "")])).drop("rank")) == [
        ("en", "a", "pair", "b", 0), ("en", "b", "pair", "a", 0),
    ]


def test_shares_are_exact_for_large_totals():
    count, total, terms = np.array([0, 7, 4 * 10**15]), np.array([8 * 10**15] * 3), np.array([123456] * 3)
    exact = [1 + 10**9 * (int(c) + 2) // (int(n) + 2 * int(v)) for c, n, v in zip(count, total, terms)]
    assert source_divergence._scaled(count, total, terms).tolist() == exact


# Secret scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32])


def written(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in spans)


def random_texts(n):
    pick = random.Random(11)
    pieces = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", ":", "=", '"', "'", " ", "  ", "\n", "é", "日", "😀", "AKIA", "ABCD1234", "0f" * 8, "beef", "x", "-", "/", ".", "ABC+/_.=-"]
    return ["".join(pick.choices(pieces, k=pick.randint(0, 40))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark):
    texts = [*random_texts(1500), None, "", "token=" + "a" * 7, "token=" + "a" * 8, "AKIA" + "A" * 11, "AKIA" + "A" * 12, "f" * 31, "f" * 32, "😀é " + "f" * 40]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", 2, "y")] * 2, "doc_id long, text string, start int, spans string")
    found = secret_scan.scan(docs.repartition(4)).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        spans = base_spans("token=abcdefgh" if r.doc_id is None else texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in written(spans).split(",") if x]


def plain_p(token):
    """The battery for one token, from its definition."""
    v = re.sub("=+$", "", token)
    symbols = next(s for c, also, s in secret_scan.ENCODINGS if re.match(c, v) and (not also or re.search(also, v)))
    if symbols is None or len(v) < secret_scan.LENGTHS[0]:
        return None
    if len(symbols) == 16:
        v = v.lower()
    x, n, k = [symbols.index(c) for c in v], len(v), len(symbols)
    chi = k / n * sum(v.count(c) ** 2 for c in symbols) - n
    z = [((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))]
    high = [2 * c >= k for c in x]
    both = 2 * sum(high) * (n - sum(high))
    spread = both * (both - n) / (n * n * (n - 1))
    z.append((1 + sum(a != b for a, b in zip(high, high[1:])) - both / n - 1) / math.sqrt(spread) if spread > 0 else 9)
    varied = n * sum(c * c for c in x) - sum(x) ** 2
    serial = (n * sum(a * b for a, b in zip(x, x[1:] + x[:1])) - sum(x) ** 2) / varied if varied else None
    z.append((serial + 1 / (n - 1)) / (n / ((n - 1) * math.sqrt(n - 2))) if varied else 9)
    ps = [math.erfc(z[0] / math.sqrt(2)) / 2, *[math.erfc(abs(y) / math.sqrt(2)) for y in z[1:]]]
    h = -sum(math.log(max(p, 1e-12)) for p in ps)
    return math.exp(-h) * (1 + h + h * h / 2)


def plain_level(token):
    p = plain_p(token)
    return None if p is None else sum(p >= e for e in secret_scan.GRID)


def brute_scan(texts, rate):
    """All spans of each text, from the definition: tokens between assignments without other base spans, windows of ordinary
    letters, and the least level of each length class at which false discoveries are few enough."""
    def length_class(n):
        return sum(n >= e for e in secret_scan.LENGTHS) - 1

    tokens, windows = [], Counter()
    for text in texts:
        edges = [0, *[x for m in ASSIGN.finditer(text) for x in m.span()], len(text)]
        found = []
        for a, b in zip(edges[::2], edges[1::2]):
            for m in re.finditer(secret_scan.TOKEN, text[a:b]):
                level = plain_level(m[0])
                if not re.search("[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", m[0]) and level is not None:
                    found.append((a + m.start(), a + m.end(), length_class(len(m[0])), level))
        tokens.append(found)
        letters = re.sub(secret_scan.ORDINARY, "", text)
        place = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        for n in secret_scan.LENGTHS:
            if len(letters) >= n:
                at = place % (len(letters) - n + 1)
                level = plain_level(letters[at : at + n])
                if level is not None:
                    windows[length_class(n), level] += 1
    least = {}
    for c in range(len(secret_scan.LENGTHS)):
        levels = [x[3] for found in tokens for x in found if x[2] == c]
        ordinary = [level for (own, level), n in windows.items() for _ in range(n) if own == c]
        for level in range(len(secret_scan.GRID), -1, -1):
            passed = sum(x >= level for x in levels)
            if passed and (sum(x >= level for x in ordinary) + 1) / (len(ordinary) + 1) * len(levels) <= rate * passed:
                least[c] = level
    return [written(sorted(base_spans(t) + [(a, 3, b) for a, b, c, level in found if level >= least.get(c, 99)])) for t, found in zip(texts, tokens)]


def test_scan_equals_brute_force(spark):
    pick = random.Random(21)
    word = lambda: "".join(pick.choice(["the", "an", "tion", "ver", "lich", "ou", "re", "ing", "en", "4", "É"]) for _ in range(pick.randint(1, 9)))
    texts = []
    for i in range(160):
        pieces = [word() for _ in range(pick.randint(0, 50))]
        for _ in range(pick.randint(0, 3)):
            token = drawn(pick, pick.choice([s for _, _, s in secret_scan.ENCODINGS if s]), pick.choice([16, 22, 30, 40, 64, 120]))
            pieces.insert(pick.randint(0, len(pieces)), pick.choice(["", "token=", "secret: ", "password=x "]) + token)
        texts.append(pick.choice([" ", "\n", ", "]).join(pieces))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in secret_scan.scan(docs, rate=0.2).collect()}
    expected = brute_scan(texts, 0.2)
    assert [found[i] for i in range(len(texts))] == expected
    assert sum(x.count("random") for x in expected) > 50


def drawn(pick, symbols, n):
    return "".join(pick.choice(symbols) for _ in range(n))


def test_battery_equals_its_definition(spark):
    pick = random.Random(5)
    tokens = [drawn(pick, s, n) for _, _, s in secret_scan.ENCODINGS if s for n in (16, 25, 70)]
    tokens += ["a" * 20, "0123456789abcdef" * 3, "12345678901234567890", "state-of-the-art-technology", "ABCDEF0123456789ABCD==", "short", "ab" * 30]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i int, token string").select("i", secret_scan.randomness(F.col("token"))).collect()
    for i, p in rows:
        expected = plain_p(tokens[i])
        assert p is None if expected is None else p == pytest.approx(expected, abs=3e-6), tokens[i]


def test_random_tokens_stand_out_and_words_do_not(spark):
    pick = random.Random(9)
    word = lambda: "".join(pick.choice(["the", "an", "tion", "ver", "lich", "ou", "re", "ing", "en"]) for _ in range(pick.randint(2, 4)))
    rows, places = [], {}
    for i in range(300):
        before = " ".join(word() for _ in range(60))
        middle = drawn(pick, secret_scan._DIGITS + secret_scan._UPPER + secret_scan._LOWER, 40) if i % 3 == 0 else "".join(word() for _ in range(6))
        places[i] = f"random:{len(before) + 1}:{len(before) + 1 + len(middle)}"
        rows.append((i, f"{before} {middle} {word()}"))
    found = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(found[i].spans == places[i] for i in range(0, 300, 3))
    false = sum(found[i].n_random for i in range(300) if i % 3)
    assert hits >= 90 and false <= 0.05 * hits


def test_tokens_within_base_spans_are_not_repeated(spark):
    pick = random.Random(2)
    text = " ".join(f"token={drawn(pick, secret_scan._LOWER + secret_scan._DIGITS, 40)} {drawn(pick, '0123456789abcdef', 40)}" for _ in range(40))
    row = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_assign, row.n_hex, row.n_random) == (40, 40, 0)


def test_scan_of_an_empty_table_and_of_long_runs(spark, no_docs):
    assert secret_scan.scan(no_docs).count() == 0
    texts = ["a" * 1_000_000, "g" * 1_000_000, "9" * 1_000_000, "password" * 100_000, " ".join(["0123456789abcdefghij"] * 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    began = time.time()
    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert time.time() - began < 120
    assert [found[i].n_hex for i in range(5)] == [1, 0, 1, 0, 0]


# Ranked search


def brute_search(docs, items, top):
    tokens = [[w.translate(LOWER) for w in TERMS.findall(t or "")] for _, t in docs]
    n, total = sum(bool(w) for w in tokens), sum(map(len, tokens))
    df = Counter(w for words in tokens for w in set(words))
    out = []
    for item, text in items:
        wanted = Counter(w.translate(LOWER) for w in TERMS.findall(text or ""))
        scored = []
        for (own, _), words in zip(docs, tokens):
            tf, score = Counter(words), 0
            for w, times in wanted.items():
                if tf[w]:
                    m = 25 + 75 * len(words) * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, own is None, own or 0, own))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of items, sketches full of collisions, and slices of a few documents
        for name, value in (("BLOCK_BYTES", 200), ("BLOCK_ITEMS", 3), ("COORDINATES", 4), ("SLICE_BYTES", 300), ("FIRST", 1)):
            monkeypatch.setattr(ranked_search, name, value)
    pick = random.Random(4)
    words = [f"w{i}" for i in range(80)] + ["Éa", "日本", "X9"]
    docs = [(i, " ".join(pick.choices(words, weights=[1 / (1 + j) for j in range(len(words))], k=pick.randint(0, 40)))) for i in range(150)]
    docs += [(3, "w70 w71"), (None, "w70 w71"), (None, "w70 w71"), (200, None), (201, ""), (202, "w1 " * 30000)] + [(300 + i, "w60 w61 w62") for i in range(25)]
    items = [(i, " ".join(pick.choices(words, k=pick.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unheard of"), (23, "w60 w61 w60"), (24, "w70 w71"), (24, "w70 w71"), (None, "w5"), (25, "W60-w61!")]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, number int").repartition(4)
    queries_ = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    assert rows_of(ranked_search.search(table, queries_, top=5)) == brute_search(docs, items, 5)


def test_search_of_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(no_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.search(docs, items.filter("false")).count() == 0
    assert ranked_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_bounds_are_never_below_scores():
    """The sketch of a document bounds its exact score for every item, whatever collides."""
    pick = random.Random(8)
    block = ranked_search.make_block([0, 1], ["a b c a", "d e"])
    block.weights = np.array([pick.randint(0, 9000) for _ in block.terms.to_pylist()], np.int64)
    spots = np.array([0, 0, 1, 1, 0])
    impact = np.array([pick.randint(1, 10**6) for _ in range(5)])
    sketch = np.zeros(2)
    np.maximum.at(sketch, spots, impact)
    for own, times in block.items:
        gains = block.weights[own] * times
        assert (sketch[spots[own]] * gains).sum() >= (impact[own] * gains).sum()
