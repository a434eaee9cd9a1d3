"""Document quality by a logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Every word of a text gives four features: the word, its pair with the word before, its ending and capitals, and whether
it repeats the word before. Each is hashed to one of 2^BITS places and has the value count / sqrt(number of features). The model is trained in one task on a bounded sample of labelled documents, one
document a step, per-coordinate rates, L1 and L2 regularisation; it is an array of weights. Scoring is a sparse dot
product over the whole text, done for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.labels import LEARN_MAX, held_out, learning_sample
from docgrove.llm.tables import narrow
from docgrove.llm.words import mix, slices, text_column, word_bounds, word_hashes

BITS, EPOCHS = 18, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.1


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of `texts`: the places of four features for every word, and the bounds of each text's."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    for _, data, offsets in slices(texts):
        starts, ends, firsts = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        before = np.roll(words, 1)
        before[firsts[:-1][firsts[:-1] < firsts[1:]]] = 0  # a text's first word follows none
        places = np.empty((len(words), 4), np.uint64)
        places[:, 0] = words
        places[:, 1] = mix(words + np.uint64(1) + before * factor)
        head, second = data[starts], data[np.minimum(starts + 1, ends - 1)]
        upper = (head >= 65) & (head <= 90), (second >= 65) & (second <= 90) & (ends - starts > 1)
        last, next_to_last = data[ends - 1].astype(np.uint64), data[np.maximum(ends - 2, starts)].astype(np.uint64)
        places[:, 2] = mix(last + (next_to_last << np.uint64(8)) + (upper[0] * np.uint64(1 << 16)) + (upper[1] * np.uint64(1 << 17)) + factor)
        places[:, 3] = mix((words == before) + np.uint64(77))
        yield (places.ravel() >> np.uint64(64 - bits)).astype(np.int64), 4 * firsts


class Ftrl:
    """Follow-the-regularised-leader for logistic loss; the last place is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        error = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label
        gradient = error * values
        step = (np.sqrt(self.n[places] + gradient**2) - np.sqrt(self.n[places])) / ALPHA
        self.z[places] += gradient - step * w
        self.n[places] += gradient**2


def train(texts: pa.Array, labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all places and, last, the intercept."""
    rows = []
    for places, bounds in features(texts, bits):
        for a, b in zip(bounds.tolist(), bounds.tolist()[1:]):
            place, count = np.unique(places[a:b], return_counts=True)
            rows.append((np.append(place, 1 << bits), np.append(count / np.sqrt(max(b - a, 1)), 1.0)))
    model = Ftrl(1 << bits)
    for turn in range(epochs):
        for i in np.random.default_rng(turn).permutation(len(rows)):
            model.learn(*rows[i], labels[i])
    return model.weights().astype(np.float32)


def score(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    scores = []
    for places, bounds in features(texts, bits):
        sums = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
        counts = np.diff(bounds)
        margin = np.diff(sums[bounds]) / np.sqrt(np.maximum(counts, 1)) + float(weights[-1])
        scores.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
    return np.concatenate(scores) if scores else np.empty(0)


def fit(sample: DataFrame, bits: int = BITS, id_column: str = "doc_id") -> np.ndarray:
    """The weights learnt from a sample of (id, text, label); all 0, so every score 0.5, when it is empty."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[id_column].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        weights = train(text_column(table["text"]), table["label"].to_pylist(), bits)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary())})

    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros((1 << bits) + 1, np.float32)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
                   limit: int = LEARN_MAX, bits: int = BITS) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Only the text enters a score: null and empty texts have that of the intercept alone, equal texts equal ones. Without
    any label to learn from every score is 0.5. Other columns of `docs` are not read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(learning_sample(docs, labels, label, id_column, text, limit), bits, id_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rounded, so that the order of summing within a batch cannot be seen.
            scores = np.round(score(text_column(batch.column(1)), weights.value, bits), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_column, "score"])

    scored = narrow(docs, id_column, text).mapInArrow(run, f"`{id_column}` long, score double")
    return scored.select(id_column, held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
