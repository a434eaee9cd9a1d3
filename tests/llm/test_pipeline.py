"""The stages, each on what the one before kept, against plain readings of what they promise."""

import re
from collections import Counter

import public_tokenizers
import pytest
from conftest import edited, make, prose
from test_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from docgrove.llm import pii_semicrf, source_mixing, toxicity_zstd


@pytest.fixture(scope="module")
def tables(spark, docs, labels, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(folder / "documents.parquet"))
    labels.write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates_keep_one_of_each_group(spark, docs, tables):
    kept = corpus_pipeline.near_duplicates(spark, docs, tables)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    roots = {own: root for own, _, root in brute_components(rows)}
    want = {own for own, root in roots.items() if own is None or own == root}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and got.count(None) == 2 and got.count(11) == 1


def test_near_duplicates_never_drop_a_row_for_another_text(spark, tables):
    """Ids that clash: a and a', u and u' are near copies; v, z and blank rows share ids with other texts."""
    a, u = prose(41, 60), prose(42, 60)
    texts = [(1, a), (5, edited(a, 1, 1)), (5, u), (7, edited(u, 2, 1)), (9, prose(43, 20)), (9, prose(44, 20)), (11, ""), (11, " "), (12, prose(45, 9)), (12, prose(45, 9))]
    kept = corpus_pipeline.near_duplicates(spark, make(spark, [(i, t, "en", "s") for i, t in texts]), tables)
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert got == sorted([texts[0], texts[2], texts[4], texts[5], texts[6], texts[7], texts[8]])


def test_toxic_documents_go_and_all_others_stay(spark, docs, tables):
    kept = corpus_pipeline.toxicity(spark, docs, tables)
    scores = toxicity_zstd.toxicity_scores(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    want = sorted((r.doc_id for r in scores.collect() if r.score < corpus_pipeline.THRESHOLD), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_mixing_takes_every_document_as_often_as_its_leaf_has_epochs(spark, docs, tables):
    mixed = corpus_pipeline.mixing(spark, docs, tables)
    levels = source_mixing.document_levels()
    plain = source_mixing.mix(docs, levels, source_mixing.document_weights())
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert times == Counter((r.doc_id, r.text) for r in plain.collect()) and max(times.values()) <= 2 * source_mixing.MAX_EPOCHS
    assert sum(len((t or "").split()) * n for (_, t), n in times.items()) <= sum(len((r.text or "").split()) for r in docs.collect())


def test_packing_holds_every_token_once(spark, docs, tables):
    pieces = corpus_pipeline.packing(spark, docs, tables).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(exact.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(p.length for p in pieces) == want


def test_personal_data_is_masked(spark, docs, tables):
    masked = corpus_pipeline.personal_data(spark, docs, tables)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    row = masked.filter("doc_id = 15").first()
    assert row.text == "mail [email] or [ip], card [card], call [phone] é" and row.n_chars == len(row.text)
    assert masked.filter("text is null").count() == docs.filter("text is null").count()
    assert not any(pii_semicrf.rule_spans(r.text or "") for r in masked.collect())


def test_stages_keep_columns_and_pass_empty_tables(spark, docs, no_docs, tables):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, no_docs, tables)
        assert out.columns == no_docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, tables).count() == 0


def test_run(spark, tables, docs):
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert pieces and {p.doc_id for p in pieces} <= {r.doc_id for r in docs.collect()}
    assert not re.search("limit|sample", " ".join(name for name, _ in corpus_pipeline.STAGES))
