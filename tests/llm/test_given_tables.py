"""Held-out accuracy and recall on the given tables, and round trips against their texts."""

import os
import wave
from collections import defaultdict
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrove.llm import ann_crosspolytope, media_wav, quality_ftrl, toxicity_zstd

LARGE = os.environ.get("TEST_LARGE_DIR", "/root/testdata/sf0.1")


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(spark, scores, label):
    """(found, wrongly found, all with the label, all without) among held-out documents with a label."""
    marked = scores.filter("held_out").join(table(spark, LARGE, "labels").select("doc_id", label), "doc_id")
    rows = [(r.predicted, r[label]) for r in marked.select("predicted", label).collect()]
    return tuple(rows.count(x) for x in ((1, 1), (1, 0))) + tuple(sum(t == y for _, t in rows) for y in (1, 0))


def test_quality_of_held_out_documents(spark):
    scores = quality_ftrl.quality_scores(table(spark, LARGE, "documents"), table(spark, LARGE, "labels"))
    found, wrong, good, bad = held_out(spark, scores, "quality")
    assert good + bad > 1000 and found >= 0.98 * good and wrong <= 0.02 * bad


def test_toxicity_of_held_out_documents(spark):
    scores = toxicity_zstd.toxicity_scores(table(spark, LARGE, "documents"), table(spark, LARGE, "labels"))
    found, wrong, toxic, clean = held_out(spark, scores, "toxic")
    assert toxic > 100 and found >= 0.6 * toxic and wrong <= 0.01 * clean


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", LARGE])
def test_recall_on_the_given_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.select("vec_id", "embedding").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = defaultdict(set)
    for r in ann_crosspolytope.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0).tolist():
        scores = matrix @ matrix[i]
        order = [j for j in np.lexsort((ids, -scores)).tolist() if j != i][:20]
        hits += len(got[int(ids[i])] & {int(ids[j]) for j in order})
        total += len(order)
    assert hits >= 0.9 * total


def test_media_hold_the_texts(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    seen = 0
    for r in media_wav.media_columns(docs).collect():
        with wave.open(BytesIO(bytes(r.media))) as w:
            data = w.readframes(w.getnframes())
        assert data[: r.n_bytes] == texts[r.doc_id] and not data[r.n_bytes :].strip(b" ")
        seen += 1
    assert seen == len(texts)
