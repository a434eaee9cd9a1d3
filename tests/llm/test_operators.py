"""Each operator against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import html
import json
import re
import time
import wave
import zlib
from collections import defaultdict
from io import BytesIO

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import make
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrove.llm import (
    ann_crosspolytope,
    byte_shards,
    components,
    harmonic_packing,
    html_wrappers,
    jaccard_join,
    media_wav,
    pii_semicrf,
    quality_ftrl,
    queries,
    source_mixing,
    toxicity_zstd,
)
from docgrove.llm.words import shingle_sets, text_column

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width=5):
    words = SPACE.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_sets_have_the_sizes_of_plain_sets(docs):
    texts = [r.text for r in docs.collect()]
    sizes = [n for _, _, bounds in shingle_sets(text_column(pa.array(texts, pa.string()))) for n in np.diff(bounds).tolist()]
    assert sizes == [len(shingles(t)) for t in texts]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return sorted(((own, len(s), least.get(find(i)) if s else own) for i, ((own, _), s) in enumerate(zip(rows, sets))), key=repr)


def test_jaccard_join(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert jaccard_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("limits", [{"FREQUENT": 2, "FLUSH_ENTRIES": 64}, {"SAMPLE": 10**6, "PRODUCT_ENTRIES": 40, "GROUP_ROWS": 3, "BLOCK_SETS": 2}, {"PARTNERS": 2, "BEST": 1, "BINS": 512, "COUNTED": 0.01}])
def test_jaccard_join_does_not_depend_on_limits(docs, monkeypatch, limits):
    """What counts as frequent, how columns are sampled and cut, and how many partners are kept decide the work only."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs).collect()), key=repr)
    assert got == brute_components(rows)


def test_links_at_the_bound_are_kept(spark):
    """Sets around 0.8 in every way: no pair whose overlap reaches the bound may be discarded before it is counted."""
    words = [f"w{i}" for i in range(64)]
    texts = [" ".join(words[:n] + [f"x{n}y{i}" for i in range(m)]) for n in range(8, 64, 3) for m in range(0, n // 3)]
    docs_ = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(docs_).collect()), key=repr)
    assert got == brute_components(list(enumerate(texts)))


def test_counts_of_ranges_bound_the_overlap():
    pick = np.random.default_rng(3)
    for n in (1, 30, 3000):
        pool = pick.integers(0, 2**64, 2 * n, np.uint64)
        a, b = np.unique(pick.choice(pool, n)), np.unique(pick.choice(pool, n))
        u, v = (np.frombuffer(jaccard_join._bins(x), np.uint8) for x in (a, b))
        assert np.minimum(u, v).sum() >= len(np.intersect1d(a, b))
    assert jaccard_join._bins(np.arange(300, dtype=np.uint64)) == b""


@pytest.mark.parametrize("alphabet", ["a@.-1", "0123.", "+0( 9-", "x@y.z a@b..c d@e-f.g ", "1.23 45-6@a.b+"])
def test_rule_spans_equal_the_plain_patterns(alphabet):
    pick = np.random.default_rng(len(alphabet))
    for n in range(3000):
        text = "".join(pick.choice(list(alphabet), n % 60))
        plain = [(0, *m.span()) for m in pii_semicrf.EMAIL.finditer(text)]
        plain += [(1, *m.span()) for m in pii_semicrf.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [s for s in pii_semicrf.rule_spans(text) if s[0] < 2] == plain, text


def test_rules_are_linear_on_unbroken_runs():
    texts = ["7" * 1_000_000, "a" * 1_000_000 + "@", "a" * 500_000 + "@" + "b" * 500_000, "1.2" * 300_000, "a@" * 400_000]
    for text in texts:
        began = time.perf_counter()
        pii_semicrf.rule_spans(text)
        assert time.perf_counter() - began < 2, text[:10]


def test_byte_shards(docs, no_docs):
    rows = byte_shards.byte_shards(docs).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"]) for r in order]
    assert keys == sorted(keys)
    total, before = sum(r["size"] for r in rows), 0
    slots = defaultdict(int)
    for r in order:
        assert r.shard == min(7, (2 * before + r["size"]) * 8 // (2 * total))
        assert r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r["size"]
    assert byte_shards.byte_shards(no_docs).count() == 0


def test_written_shards_are_whole_rows_in_the_same_shards(spark, docs, tmp_path):
    byte_shards.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    want = {(r.doc_id, r.text_crc32, r.shard) for r in byte_shards.byte_shards(docs, 3).collect()}
    got = {(r.doc_id, zlib.crc32((r.text or "").encode()), r.shard) for r in back.collect()}
    assert got <= want


def test_packing(docs, no_docs):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append([*exact.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = harmonic_packing.pack(docs).collect()
    got = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.start, p.length)):
        got[p.doc_id].append(p)
    assert set(got) == set(texts)
    for own, lists in texts.items():
        assert sum(p.length for p in got[own]) == sum(map(len, lists))
        for p in got[own]:
            ok = [x for x in lists if len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32]
            assert ok
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    assert harmonic_packing.pack(no_docs).count() == 0


def test_pieces_waste_little_and_cover_the_document():
    for length in range(1, 3000):
        pieces = harmonic_packing.cut(length)
        assert sum(pieces) == length and all(0 < p <= 1024 for p in pieces)
        assert all(1024 - 1024 // p * p <= 0.06 * 1024 for p in pieces)


def test_bins_hold_a_fixed_number_of_each_class():
    bins = harmonic_packing.Bins(100)
    out = [row for length in [50, 33, 50, 33, 33, 100, 34] for row in bins.add((length,))]
    assert [(r[0], r[1]) for r in out] == [(50, 0), (50, 0), (33, 1), (33, 1), (33, 1), (100, 2)]
    assert bins.close() == [(34, 3, 0)]


def test_media(docs, no_docs):
    media = media_wav.media_columns(docs)
    rows = {(r.doc_id, r.n_bytes): r for r in media.collect()}
    by_payload = defaultdict(set)
    for r in media_wav.digests(media).collect():
        wav = bytes(rows[r.doc_id, r.n_bytes].media)
        with wave.open(BytesIO(wav)) as w:
            data = w.readframes(w.getnframes())
        assert len(data) == r.payload_bytes and len(data) % 192 == 0 and len(data) > 0
        assert data[r.n_bytes :].strip(b" ") == b"" and len(data) - r.n_bytes < 192 + 192 * (r.n_bytes == 0)
        assert (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])) == (r.payload_sha256, r.tail_crc32)
        assert (len(wav), hashlib.sha256(wav).hexdigest()) == (r.media_bytes, r.media_sha256)
        by_payload[data].add(r.feature)
    assert all(len(x) == 1 for x in by_payload.values())
    assert media_wav.digests(media_wav.media_columns(no_docs)).count() == 0


def test_short_payloads_have_features():
    texts = [" ".join(hashlib.sha256(bytes([i])).hexdigest()) for i in range(20)]
    found = [media_wav.fingerprint(media_wav.payload(t)[1]) for t in texts]
    assert all(len(times) for times, _ in found) and len({c.tobytes() for _, c in found}) > len(texts) / 2  # before, all were empty
    times, codes = media_wav.fingerprint(media_wav.payload("one")[1])
    assert (times == 0).all() and all(c & 15 == 0 and c >> 11 < c >> 4 & 127 for c in codes.tolist())


def test_band_peaks_equal_a_plain_transform():
    data = np.random.default_rng(0).integers(0, 256, 2048).astype(np.uint8)
    bins, _ = media_wav.band_peaks(data)
    place = np.arange(256)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * place / 256)
    same = 0
    for i, row in enumerate(bins):
        power = np.abs(np.fft.rfft((data[i * 128 : i * 128 + 256] - 128.0) * window))[1:129]
        same += sum(power.reshape(4, 32).argmax(axis=1) + 32 * np.arange(4) == row)
    assert same >= 0.98 * bins.size


def test_quality_learns_what_marks_junk():
    good = [f"the {i} quiet house stood near the river and {i + 1} people" for i in range(60)]
    junk = [f"word{i} word{i} word{i} word{i} click!! here!! {i}!!" for i in range(60)]
    texts = pa.array(good + junk, pa.large_string())
    weights = quality_ftrl.train(texts, [1] * 60 + [0] * 60)
    other = pa.array(["a new quiet house near people", "odd odd odd odd buy!! now!!", "", None], pa.string())
    scores = quality_ftrl.score(text_column(other), weights)
    assert scores[0] > 0.5 > scores[1] and scores[2] == scores[3]


@pytest.mark.parametrize("operator", [quality_ftrl.quality_scores, toxicity_zstd.toxicity_scores])
def test_scores_have_a_row_for_every_row(docs, no_docs, labels, operator):
    rows = operator(docs, labels).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((r.doc_id for r in docs.collect()), key=repr)
    cut = 0.5 if operator is quality_ftrl.quality_scores else 0.7
    for r in rows:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    assert operator(no_docs, labels).count() == 0
    assert {r.score for r in operator(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_learns_words_that_mark_texts():
    pick = np.random.default_rng(0)
    common = [f"{a}{b}" for a in "ba ke lo mu ri sa te vo".split() for b in "na ro li de ku".split()]
    texts = [list(pick.choice(common, 60)) for _ in range(300)]
    for text in texts[:100]:
        for at in pick.integers(0, 60, 4):
            text[at] = pick.choice(["scumbag", "worthless", "disgusting"])
    joined = [" ".join(t) for t in texts]
    model = toxicity_zstd.train(pa.array(joined[:80] + joined[100:250], pa.large_string()), [1] * 80 + [0] * 150)
    scores = toxicity_zstd.score(pa.array(joined[80:100] + joined[250:] + ["", " "], pa.large_string()), model)
    assert np.mean(scores[:20] >= 0.7) >= 0.9 and np.mean(scores[20:70] < 0.7) >= 0.95 and scores[70] == scores[71] < 0.7


def brute_rules(text):
    base = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text):
        base.append(("email", m))
    base += [("ip", m) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        own = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(own) <= 19 and sum(own[::2] + [sum(divmod(2 * d, 10)) for d in own[1::2]]) % 10 == 0:
            base.append(("card", m))
    base += [("phone", m) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in base]


def test_personal_data(docs, no_docs, spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    both = docs.select("doc_id", "text").unionByName(given.select("doc_id", "text"))
    texts = defaultdict(list)
    for r in both.collect():
        texts[r.doc_id].append(r.text or "")
    for r in pii_semicrf.find(both).collect():
        rules = [x for x in map(brute_rules, texts[r.doc_id]) if hashlib.sha256(",".join(x).encode()).hexdigest() == r.base_sha256]
        assert rules
        spans = r.spans.split(",") if r.spans else []
        assert set(rules[0]) <= set(spans) and len(spans) == len(rules[0]) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in rules[0]) for k in pii_semicrf.KINDS]
    assert pii_semicrf.find(no_docs).count() == 0


def test_the_best_labelling_and_its_sums_equal_brute_force():
    text = "mail x@y.example and 10.0.0.1 or 4111 1111 1111 1111 then"
    place = pii_semicrf.places(text)[0][:8]
    lattice = pii_semicrf.Lattice(text, place)
    scores = np.random.default_rng(1).normal(0, 2, (len(lattice.segments), 4))

    def every(at):
        if at == len(place):
            yield 0.0, []
            return
        for total, rest in every(at + 1):
            yield total, rest
        for s, (i, j, _) in enumerate(lattice.segments):
            if i == at:
                for total, rest in every(j):
                    for kind in range(4):
                        yield total + scores[s, kind], [(s, kind), *rest]

    found = list(every(0))
    best = max(found, key=lambda x: x[0])[1]
    assert lattice.best(scores) == [(k, place[lattice.segments[s][0]][0], place[lattice.segments[s][1] - 1][1]) for s, k in best]
    weight = np.exp([t for t, _ in found])
    chance = np.zeros_like(scores)
    for w, (_, chosen) in zip(weight / weight.sum(), found):
        for s, kind in chosen:
            chance[s, kind] += w
    assert np.allclose(lattice.expected(scores), chance)


def test_the_field_finds_other_forms_and_masks_them():
    texts = [f"word {i} mail a{i}@mail{i % 9}.example.com and 10.{i % 200}.3.4 so call +1 (5{i % 90 + 10}) 555-01{i % 90 + 10} end" for i in range(120)]
    weights = pii_semicrf.train(texts)
    base, every = pii_semicrf.all_spans("please call 1 (555) 555-0199 at once", weights)
    assert not base and [k for k, *_ in every] == [3]
    assert pii_semicrf.all_spans("chapter 12 has 48 pages", weights) == ([], [])


def test_the_field_sees_entities_of_any_length_and_place():
    pair = "+{} 6 {} {} {} {}", "a{}@mail{}.example.com"
    texts = ["ab" * (i % 12) + f" word call {pair[0].format(33 + i % 7, i % 90 + 10, i % 80 + 11, i % 70 + 12, i % 60 + 13)} or mail {pair[1].format(i, i % 9)} end" for i in range(240)]
    first = [len(truth) for _, truth in pii_semicrf._lessons(texts[0])]
    assert first == [2, 2]  # as it stands and rewritten
    weights = pii_semicrf.train(texts)

    def added(text):
        base, every = pii_semicrf.all_spans(text, weights)
        return [(pii_semicrf.KINDS[k], text[a:b]) for k, a, b in sorted(set(every) - set(base), key=lambda s: s[1])]

    assert added("word call 0034 6 12 34 56 78 end") == [("phone", "0034 6 12 34 56 78")]
    assert added("word mail a7 (at) mail3 (dot) example (dot) com end") == [("email", "a7 (at) mail3 (dot) example (dot) com")]
    phones = [f"0034 6 {10 + i} 34 56 78" for i in range(60)]
    phones = [x for x in phones if not pii_semicrf.luhn(pii_semicrf.digits(x))]  # what has a card's check sum may be one
    assert added("word call " + " or call ".join(phones) + " end") == [("phone", x) for x in phones]  # one place of some 400 chunks
    assert len(pii_semicrf.places("word call " + " or call ".join(phones))) == 1


@pytest.mark.parametrize("text", [
    "\u7535\u8bdd0033612345678\u8bf7\u8054\u7cfb", '{"name":"x","phone":"0033612345678","more":[' + "1," * 60 + '2]}', "y" * 50 + ",0033612345678," + "z" * 60,
    "phone:0033612345678;" + "name=abc&" * 20, '{"phone":0033612345678}',
])
def test_entities_in_text_without_spaces_are_segments(text):
    found = [text[chunks[i][0] : chunks[j - 1][1]] for chunks in pii_semicrf.places(text) for i, j, _ in pii_semicrf.Lattice(text, chunks).segments]
    assert "0033612345678" in found


def test_segments_grow_with_the_chunks_only():
    for text in ("12 " * 20000, "1 - " * 9000, "a@b.example c " * 9000, "a (dot) " * 1000 + "b (at) c", "123," * 20000, "\u75355" * 20000):
        chunks = [c for place in pii_semicrf.places(text) for c in place]
        made = sum(1 for place in pii_semicrf.places(text) for _ in pii_semicrf.segments(text, place))
        assert 0 < made <= 64 * len(chunks)


def brute_nearest(ids, x, query, k):
    scores = x @ x[query]
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[query]), key=lambda i: (-scores[i], ids[i]))
    return [ids[i] for i in order[:k]]


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_nearest_recall(spark, lengths):
    pick = np.random.default_rng(0)
    x = pick.normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "unequal":
        x *= pick.uniform(0.5, 2, (len(x), 1))
    x[100:400] = x[7] + 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann_crosspolytope.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in range(0, 1500, 20):
        own = sorted(got[i])
        assert [r for r, *_ in own] == list(range(1, 21))
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert np.allclose([s for *_, s in own], [x[v] @ x[i] for _, v, _ in own], atol=1e-12)
        hits += len({v for _, v, _ in own} & set(brute_nearest(list(range(1500)), x, i, 20)))
    assert hits >= 0.9 * 20 * 75


def test_nearest_of_few_and_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (20, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    rows += [(6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (40, [-1.0, 0.5]), (40, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, t int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_crosspolytope.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1), (0, 3, 40), (40, 1, 1), (40, 2, 0), (40, 3, 2)]
    assert ann_crosspolytope.nearest(df.limit(0), F.lit(True)).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>x</a></li></ul></nav>{top}<article><h1>{h}</h1>{body}</article>{foot}</body></html>"


def test_main_text_of_pages(spark):
    rows = [
        (1, "http://a.example/1", PAGE.format(top="", h="A &amp; b", body="<p>one<br>two <b>x</b></p><p>three", foot="<footer>f</footer>")),
        (2, "http://A.example:80/2", PAGE.format(top='<div class="ad">buy</div>', h="B", body="<p>four</p>", foot='<div id="comments"><p>bad</p></div>')),
        (3, "https://b.example/", "<div><p>c &lt; d<p>e</div><aside>no</aside><form>no<input></form><script>var t='</p>';</script>"),
        (4, None, None),
        (5, "x", ""),
        (5, "x", "plain < text > here &nbsp; &#233;"),
        (6, "http://a.example/3", "<article>" + "<p>w</p>" * 5000 + "<!-- never closed"),
    ]
    df = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_wrappers.extract(df).collect())
    want = [
        (1, "A & b\n\none two x\n\nthree"), (2, "B\n\nfour"), (3, "c < d\n\ne"), (4, ""), (5, ""),
        (5, "plain < text > here é"), (6, "\n\n".join(["w"] * 5000)),
    ]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_wrappers.extract(df.limit(0)).count() == 0


def test_a_host_with_and_without_articles_keeps_the_text_of_both(spark):
    rows = [(1, "http://h.example/1", "<body><nav>n</nav><article><p>one</p></article><footer>f</footer></body>")]
    rows += [(i, f"http://h.example/{i}", f"<body><nav>n</nav><div class=content><p>text {i}</p></div><footer>f</footer></body>") for i in range(2, 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrapper = json.loads(html_wrappers.infer_wrappers(df).collect()[0].wrapper)
    assert all(html_wrappers.Wrapper(wrapper).places(html_wrappers.tokens(r[2])[0]) for r in rows)
    got = {r.page_id: r.text for r in html_wrappers.extract(df).collect()}
    assert got == {1: "one"} | {i: f"text {i}" for i in range(2, 6)}


def test_texts_on_all_pages_of_a_host_are_its_template(spark):
    page = '<body class="no-sidebar"><div>Menu of h</div><div class="content has-sidebar"><h2>{h}</h2><p>text {i}</p><p>All rights</p></div></body>'
    rows = [(i, f"http://h.example/{i}", page.format(i=i, h="T" if i % 2 else "U")) for i in range(6)]
    rows += [(6, "http://h.example/6", rows[5][2])]  # a copy says nothing more
    rows += [(10 + i, "http://two.example/", f"<div>Menu</div><p>text {i % 2}</p>") for i in range(8)]  # two different pages: too few to tell
    rows += [(20 + i, "http://w.example/", f'<div class="widget"><p>Menu</p><p>text {i}</p></div>') for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.extract(df).collect()}
    want = {i: ("T" if i % 2 else "U") + f"\n\ntext {i}" for i in range(6)} | {6: "T\n\ntext 5"}
    assert got == want | {10 + i: f"Menu\n\ntext {i % 2}" for i in range(8)} | {20 + i: f"text {i}" for i in range(3)}


def test_given_pages_equal_a_plain_reading(spark, sf):
    for r in queries.op10_html_wrappers(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_wrappers_align_to_optional_and_repeated_groups():
    one = html_wrappers.collapse(["ul", "li", "#x", "li", "#x", "/ul", "h1", "#o"])
    other = html_wrappers.collapse(["ul", "li", "#x", "/ul", "hr", "h1", "#o", "div", "/div"])
    both = html_wrappers.align(one, other)
    assert both == [["ul", False], [["li", "#x"], False], ["/ul", False], ["hr", True], ["h1", False], ["#o", False], ["div", True], ["/div", True]]
    wrapper = html_wrappers.Wrapper(json.loads(json.dumps(both)))
    assert wrapper.places(["ul", "li", "#x", "li", "#x", "li", "#x", "/ul", "h1", "#o"]) == [9]
    assert wrapper.places(["ol", "h1", "#o"]) is None


def water(children, given):
    """Weights and capacities by name -> amounts, by handing out again what a full child leaves over."""
    out, rest, open_ = {}, given, {k: v for k, v in children.items() if v[0] > 0}
    out.update({k: 0 for k in children if k not in open_})
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [k for k, (w, c) in open_.items() if c * total <= rest * w]
        if not full:
            for k, (w, _) in open_.items():
                out[k] = rest * w / total
            break
        for k in full:
            out[k] = open_.pop(k)[1]
        rest = given - sum(out.values())
    return out


def test_a_shortage_goes_to_siblings_first(spark):
    rows = [("p", "a", "1", 10), ("p", "a", "2", 1000), ("p", "b", "3", 5), ("q", "c", "4", 400), ("q", "c", "5", 600), ("z", "c", "6", 900)]
    leaves = spark.createDataFrame(rows, "d string, l string, s string, tokens long")
    weights = {"d": F.when(F.col("d") == "z", 0).otherwise(F.when(F.col("d") == "p", 3).otherwise(1)), "l": F.lit(2)}
    got = {r.s: r.budget for r in source_mixing.leaf_budgets(leaves, ["d", "l", "s"], weights, 800, 1).collect()}
    top = water({"p": (3, 1015), "q": (1, 1000)}, 800)
    below = water({"a": (2, 1010), "b": (2, 5)}, top["p"])
    want = water({"1": (1, 10), "2": (1, 1000)}, below["a"]) | {"3": below["b"], "6": 0} | water({"4": (1, 400), "5": (1, 600)}, top["q"])
    assert sum(got.values()) == 800 and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_mixing_takes_whole_epochs_and_a_prefix(docs, no_docs):
    levels, weights = source_mixing.document_levels(), source_mixing.document_weights()
    mixed = source_mixing.mix(docs, levels, weights)
    assert mixed.columns == [*docs.columns, "epoch_"]
    leaf = [F.coalesce(c, F.lit("")).alias(n + "_of") for n, c in levels.items()]
    tokens = source_mixing.token_count(F.col("text")).alias("tokens")
    given = docs.select(*leaf, "doc_id", "text", tokens).collect()
    want_leaves = docs.select(*[c.alias(n[:-3]) for n, c in zip(["domain_of", "lang_of", "source_of"], [F.coalesce(c, F.lit("")) for c in levels.values()])], tokens)
    budgets = source_mixing.leaf_budgets(want_leaves.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")), list(levels), weights, None, 4)
    budgets = {(r.domain, r.lang, r.source): r.budget for r in budgets.collect()}
    want = []
    for own, budget in budgets.items():
        rows = [r for r in given if tuple(r)[:3] == own]
        total = sum(r.tokens for r in rows)
        epochs, rest = divmod(budget, total) if total else (0, 0)
        for e in range(epochs):
            want += [(r.doc_id, r.text, e) for r in rows]

        def place(r):
            text = hashlib.md5((r.text or "").encode()).hexdigest()
            return hashlib.md5(f"17:{epochs}:{'' if r.doc_id is None else r.doc_id}:{text}".encode()).hexdigest()

        for h in sorted({place(r) for r in rows}):
            same = [r for r in rows if place(r) == h]
            rest -= sum(r.tokens for r in same)
            if rest < 0:
                break
            want += [(r.doc_id, r.text, epochs) for r in same]
    got = [(r.doc_id, r.text, r.epoch_) for r in mixed.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert source_mixing.mix(no_docs, levels, weights).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_duckdb(spark, sf, name):
    duck = duckdb.connect()
    for table in "documents embeddings pages labels".split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = duck.execute(queries.ORACLE[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    want = sorted((tuple(row[theirs.index(c)] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr) == want


def page_texts(spark, sources, url="https://h.example/{}"):
    rows = [(i, url.format(i), x) for i, x in enumerate(sources)]
    found = html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_names_exclude_nothing_that_belongs_to_the_article(spark):
    sources = [
        '<article><div class="entry-header"><h2 class="section-header">Head</h2></div><p class="social-contract">One</p>'
        '<div class="related-work">Two</div><header>Three</header><div class="ad">no</div><div id="comment-list">no</div><form>no</form></article>',
        '<main><div class="cookie-recipe">Flour</div><div class="cookie-notice">no</div></main>',
        '<article><p>Text</p><article class="comment">no</article><section id="comments"><article>no</article></section><article>teaser</article></article>',
        '<section class="comments"><article>no</article></section><article><p>Main</p></article>',
        '<article><article><p>Only one</p></article></article>',
        '<div class="ad"><article><p>Left open</p></article>',
        '<div class="site-header">no</div><div class="has-sidebar">Body</div><div class="sidebar">no</div>',
    ]
    assert page_texts(spark, sources) == ["Head\n\nOne\n\nTwo\n\nThree", "Flour", "Text", "Main", "Only one", "Left open", "Body"]


def test_notice_that_differs_on_one_page_is_still_the_template(spark):
    sources = [f"<div><h1>Title {i}</h1><p>Story {i}</p><div>We use biscuits{'.' if i else '!'}</div></div>" for i in range(10)]
    found = page_texts(spark, sources)
    assert found[1:] == [f"Title {i}\n\nStory {i}" for i in range(1, 10)]


def test_host_of_many_different_streams(spark):
    """Streams are folded as a tree, some in each task."""
    pick = np.random.default_rng(5)
    tags = ["p", "h2", "ul", "div", "pre", "blockquote"]
    sources = ["<article>" + "".join(f"<{t}>x{i} {k}</{t}>" for k, t in enumerate(pick.choice(tags, 6))) + "</article><footer>no</footer>" for i in range(300)]
    assert page_texts(spark, sources) == ["\n\n".join(f"x{i} {k}" for k in range(6)) for i in range(300)]
