"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window more.

A text is covered by overlapping windows of a few whole words. Each is compressed with a dictionary of toxic and one of ordinary text;
both hold the same trained base of ordinary text, so they differ only in what is peculiar to either side. Bytes saved
by the toxic one are evidence: for each saving, the log ratio of how often windows of toxic and of ordinary documents
have it, learnt from labelled documents. A document's evidence is the sum over all its windows, and a logistic
curve fitted to labelled documents turns it into a score, so that a score can be read as a chance.

Training, in one task on a bounded sample: the toxic side is the words that set toxic documents apart (by likelihood
ratio over distinct texts); the ordinary side is, after a first round with ordinary words at random, the words of those
ordinary windows that the first round took for toxic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrove.llm.labels import LEARN_MAX, held_out, learning_sample
from docgrove.llm.tables import narrow
from docgrove.llm.words import release, slices, text_column, word_bounds

WINDOW_WORDS, STEP_WORDS, BASE_BYTES, PECULIAR_WORDS = 6, 3, 8192, 96
#: A word is peculiar to toxic texts only if so many distinct ones have it, so many times as often as ordinary ones.
LEAST_TEXTS, TIMES = 4, 3.0
#: Savings in bytes are taken between these; log ratios of no saving at all are one value.
LEAST_SAVED, MOST_SAVED = 0, 15
THRESHOLD = 0.7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    evidence: tuple[float, ...]
    slope: float
    start: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=settings)


def _lengths(compressor: zstandard.ZstdCompressor, windows: zstandard.BufferWithSegments) -> np.ndarray:
    made = compressor.multi_compress_to_buffer(windows, threads=0)
    return np.fromiter((len(x) for x in made), np.int64, len(made))


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW_WORDS, step: int = STEP_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each window of `size` words, one every `step` words up to the last word, with the space at
    either side; and the bounds of each text's."""
    starts, ends, firsts = word_bounds(data, offsets)
    words = np.diff(firsts)
    per = np.where(words > 0, 1 - (-np.maximum(words - size, 0) // step), 0)
    bounds = np.concatenate([[0], np.cumsum(per)])
    owner = np.repeat(np.arange(len(per)), per)
    first = firsts[:-1][owner] + step * (np.arange(bounds[-1]) - bounds[:-1][owner])
    last = np.minimum(first + size, firsts[1:][owner]) - 1
    return np.maximum(starts[first] - 1, offsets[owner]), np.minimum(ends[last] + 1, offsets[owner + 1]), bounds


def savings(texts: pa.Array, toxic: bytes, ordinary: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For slices of `texts`: bytes each window saves by the toxic dictionary, bounds of each text's windows, and the
    lower-cased bytes with the windows' begins and ends."""
    one, other = _compressor(toxic), _compressor(ordinary)
    for _, data, offsets in slices(texts):
        begins, ends, bounds = windows(data, offsets)
        lower = data.tobytes().translate(_LOWER)
        saved = np.empty(0, np.int64)
        if len(begins):
            segments = np.stack([begins, ends - begins], 1).astype(np.uint64).tobytes()
            cut = zstandard.BufferWithSegments(lower, segments)
            saved = _lengths(other, cut) - _lengths(one, cut)
        yield saved, bounds, lower, begins, ends


def _evidence(texts: pa.Array, model: Model) -> np.ndarray:
    table = np.array(model.evidence)
    sums = []
    for saved, bounds, *_ in savings(texts, model.toxic, model.ordinary):
        value = table[np.clip(saved, LEAST_SAVED, MOST_SAVED) - LEAST_SAVED]
        sums.append(np.diff(np.concatenate([[0.0], np.cumsum(value)])[bounds]))
    return np.concatenate(sums) if sums else np.empty(0)


def score(texts: pa.Array, model: Model) -> np.ndarray:
    if not model.toxic:
        return np.full(len(texts), 1 / (1 + math.exp(-model.start)))
    return 1 / (1 + np.exp(-np.clip(model.slope * _evidence(texts, model) + model.start, -35, 35)))


def _peculiar(texts: list[bytes], labels: np.ndarray) -> list[bytes]:
    """Words that set toxic texts apart, weakest first."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [0, 0]
    for text, label in dict(zip(texts, labels.tolist())).items():
        counts[label].update(set(text.split()))
        totals[label] += 1
    every = sum(totals)

    def ratio(word: bytes) -> float:
        a, b = counts[1][word], counts[0][word]
        parts = [(a, (a + b) * totals[1] / every), (b, (a + b) * totals[0] / every)]
        return sum(2 * n * math.log(n / mean) for n, mean in parts if n)

    words = [w for w, n in counts[1].items() if n >= LEAST_TEXTS and n / totals[1] > TIMES * (counts[0][w] + 0.5) / max(totals[0], 1)]
    return sorted(words, key=lambda w: (ratio(w), w))[-PECULIAR_WORDS:]


def _base(texts: list[bytes], random: np.random.Generator) -> bytes:
    samples = []
    for text in texts:
        words = text.split()
        for at in random.integers(0, max(1, len(words) - 8), 2).tolist():
            samples.append(b" ".join(words[at : at + 8]) + b" ")
    try:
        return zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-BASE_BYTES:]


def _ratios(texts: pa.Array, labels: np.ndarray, toxic: bytes, ordinary: bytes) -> tuple[float, ...]:
    counts = np.zeros((2, MOST_SAVED - LEAST_SAVED + 1))
    at = 0
    for saved, bounds, *_ in savings(texts, toxic, ordinary):
        own = np.repeat(labels[at : at + len(bounds) - 1], np.diff(bounds))
        at += len(bounds) - 1
        np.add.at(counts, (own, np.clip(saved, LEAST_SAVED, MOST_SAVED) - LEAST_SAVED), 1)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    return tuple(np.log(share[1] / share[0]).tolist())


def _mistaken(texts: pa.Array, labels: np.ndarray, toxic: bytes, ordinary: bytes, known: set[bytes]) -> list[bytes]:
    """Words of ordinary texts' windows that save most by the toxic dictionary, most last."""
    found, at = [], 0
    for saved, bounds, lower, begins, ends in savings(texts, toxic, ordinary):
        own = np.repeat(labels[at : at + len(bounds) - 1], np.diff(bounds))
        at += len(bounds) - 1
        for i in np.flatnonzero((own == 0) & (saved >= 3)).tolist():
            found.append((int(saved[i]), lower[begins[i] : ends[i]]))
    found.sort()
    words = dict.fromkeys(w for _, window in reversed(found) for w in window.split() if w not in known)
    return list(words)[::-1]


def _curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and start of the logistic curve through the labels, by Newton's method with a little damping."""
    x = np.stack([evidence, np.ones(len(evidence))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - labels) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(curve, slope)
    return float(w[0]), float(w[1])


def train(texts: pa.Array, labels: list[int]) -> Model:
    """The model; with labels of one kind only, or none peculiar, a constant score."""
    marks = np.array(labels, np.int64).clip(0, 1)
    plain = [t.as_py().encode().translate(_LOWER) for t in texts]
    words = _peculiar(plain, marks) if 0 < marks.sum() < len(marks) else []
    if not words:
        share = (marks.sum() + 0.5) / (len(marks) + 1)
        return Model(b"", b"", (), 0.0, math.log(share / (1 - share)))
    random = np.random.default_rng(0)
    ordinary_texts = [t for t, m in zip(plain, marks) if not m]
    base = _base(ordinary_texts, random)
    own = b" " + b" ".join(words) + b" "
    pool = [w for t in ordinary_texts for w in t.split()[:64]] or [b" "]
    other = b" ".join(pool[i] for i in random.integers(0, len(pool), len(own)).tolist())[-len(own) :]
    hard = _mistaken(texts, marks, base + own, base + other, set(words))
    other = (other + b" " + b" ".join(hard) + b" ")[-len(own) :]
    model = Model(base + own, base + other, _ratios(texts, marks, base + own, base + other), 1.0, 0.0)
    # A single ordinary window is an ordinary text as well: a text that says next to nothing is not taken for toxic.
    short = pa.array([b" ".join(t.split()[:WINDOW_WORDS]) for t in ordinary_texts], pa.large_binary()).cast(pa.large_string())
    evidence = np.concatenate([_evidence(texts, model), _evidence(short, model)])
    slope, start = _curve(evidence, np.concatenate([marks, np.zeros(len(short), np.int64)]))
    return Model(model.toxic, model.ordinary, model.evidence, max(slope, 0.0), start)


def fit(sample: DataFrame, id_column: str = "doc_id") -> Model:
    """The model learnt from a sample of (id, text, label); a constant score of 0.5 when it is empty."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table[id_column].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        made = train(text_column(table["text"]), table["label"].to_pylist())
        release()
        return pa.Table.from_pylist([vars(made) | {"evidence": list(made.evidence)}], schema=kinds)

    kinds = pa.schema([("toxic", pa.binary()), ("ordinary", pa.binary()), ("evidence", pa.list_(pa.float64())), ("slope", pa.float64()), ("start", pa.float64())])
    schema = "toxic binary, ordinary binary, evidence array<double>, slope double, start double"
    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, schema).collect()
    if not rows:
        return Model(b"", b"", (), 0.0, 0.0)
    row = rows[0]
    return Model(bytes(row.toxic), bytes(row.ordinary), tuple(row.evidence), row.slope, row.start)


def toxicity_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
                   limit: int = LEARN_MAX) -> Model:
    return fit(learning_sample(docs, labels, label, id_column, text, limit), id_column)


def toxicity_column(model: Model):
    """An Arrow UDF from text to score. Null and blank texts have no window and the score of no evidence."""

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        scores = pa.array(np.round(score(text_column(texts), model), 6), pa.float64())
        release()
        return scores

    return toxicity


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
                    limit: int = LEARN_MAX, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Only the text enters a score, so equal texts have equal ones. Without labels of both kinds to learn from all scores
    are one constant. Rows without an id are scored like others; other columns of `docs` are not read.
    """
    toxicity = toxicity_column(toxicity_model(docs, labels, id_column, text, label, limit))
    scored = narrow(docs, id_column, text).select(id_column, toxicity(F.col(text)).alias("score"))
    return scored.select(
        id_column, held_out(F.col(id_column)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
