"""Classification of documents by a batch model the user supplies, with a cache by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgrove import schemas
from docgrove.functions.labels import path_parts, tag_json
from docgrove.functions.text import clean_response, prepare_text, request_filler
from docgrove.operators.matching import match_answers

# Called in each task to make the client; the client gets a document key and a request, and answers. A client with a
# method `answer_all` gets lists of keys and requests instead and returns a list: an answer, or the exception, for each.
Provider = Callable[[], Callable[[str, str], str | None]]

#: Requests of a list at most, and their bytes.
BATCH_REQUESTS, BATCH_BYTES = 256, 4 << 20


def cache_lookup(docs: DataFrame, cache: DataFrame, version: Column | str) -> DataFrame:
    """`docs` (with `obj_key`, `content_hash`) plus `cached_path`, null unless document, body and label
    tree are all the same as when it was cached. `cache` has one row per document: the join is by document
    alone, as the newest rows of the cache are laid out already."""
    version = F.lit(version) if isinstance(version, str) else version
    known = cache.select(
        F.col("obj_token").alias("obj_key"),
        F.col("content_hash").alias("cached_hash"),
        F.when(F.col("taxonomy_version") == version, F.col("path")).alias("cached"),
    )
    hit = F.when(F.col("content_hash") == F.col("cached_hash"), F.col("cached")).alias("cached_path")
    return docs.join(known, "obj_key", "left").select(*docs.columns, hit)


def model_requests(docs: DataFrame) -> DataFrame:
    """`(obj_key, text)` for documents with a body. Filter blank, cached and finished ones before this:
    no filter moves below the model call by itself."""
    return docs.select("obj_key", prepare_text(F.col("content"), F.col("title")).alias("text"))


def _one_by_one(model: Callable[[str, str], str | None]) -> Callable[[list[str], list[str]], list]:
    def answer_all(keys: list[str], requests: list[str]) -> list:
        answers = []
        for key, request in zip(keys, requests):
            try:
                answers.append(model(key, request))
            except Exception as failure:
                answers.append(failure)
        return answers

    return answer_all


def _isolated(ask: Callable[[list[str], list[str]], list], keys: list[str], requests: list[str]) -> list:
    """Answers to a batch. A batch that fails as a whole, or comes back with another number of answers, is asked again in
    halves until the request at fault stands alone: k of n cost about k * log2(n) calls more."""
    try:
        answers = list(ask(keys, requests))
        if len(answers) == len(keys):
            return answers
        failure: Exception = ValueError(f"{len(answers)} answers to {len(keys)} requests")
    except Exception as raised:
        failure = raised
    if len(keys) == 1:
        return [failure]
    half = len(keys) // 2
    return _isolated(ask, keys[:half], requests[:half]) + _isolated(ask, keys[half:], requests[half:])


def _batches(requests: Iterator[tuple[str, str]]) -> Iterator[tuple[list[str], list[str]]]:
    """Keys and requests in batches of at most BATCH_REQUESTS and about BATCH_BYTES; a longer request is a batch of its own."""
    keys, texts, size = [], [], 0
    for key, text in requests:
        length = len(text.encode())
        if keys and (len(keys) == BATCH_REQUESTS or size + length > BATCH_BYTES):
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += length
    if keys:
        yield keys, texts


def _filled(batches: Iterator[pd.DataFrame], fill: Callable[[str], str]) -> Iterator[tuple[str, str]]:
    """Keys and filled requests; a batch is let go before the next one is read."""
    for batch in batches:
        for key, text in zip(batch["obj_key"], batch["text"]):
            yield key, fill(text)
        batch = key = text = None


def call_model(requests: DataFrame, provider: Provider, template: str = "{text}", **fixed: str) -> DataFrame:
    """One answer per request; layout `schemas.ANSWERS`. A failed call is an error in its row only, also where a provider
    that answers lists raises for a whole list.

    Requests are dealt out by size, so a task is short however many there are, and a lost one repeats little. As many
    calls are in flight as tasks run at once, or as the provider allows. The template and what is `fixed` in it
    travel with the task, not with each row, and a task holds one batch of filled requests at a time. The rows themselves come in
    Arrow batches; write the answers within `scratch.batch_bytes`, as a run does, and these are bounded in bytes too.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        ask = getattr(model, "answer_all", None) or _one_by_one(model)
        fill = request_filler(template, **fixed)
        for keys, texts in _batches(_filled(batches, fill)):
            answers = _isolated(ask, keys, texts)
            failed = [isinstance(a, Exception) for a in answers]
            raw = [None if f else a for a, f in zip(answers, failed)]
            errors = [f"{type(a).__name__}: {a}" if f else None for a, f in zip(answers, failed)]
            yield pd.DataFrame({"obj_key": keys, "raw_response": raw, "error": errors}, dtype=object)

    dealt = requests.select("obj_key", "text").hint("rebalance", "obj_key")
    return dealt.mapInPandas(answer, schemas.ANSWERS)


def label_answers(answers: DataFrame, index: DataFrame) -> DataFrame:
    """Add the cleaned answer, its `path` in the label tree and the `match_tier`; null after an error.

    `index` is a `label_index` of the tree. `answers` are read more than once: write them before, as a run does. Each different answer is looked up once, and rows take over what was found:
    a large answer is one large key on the side of the rows, which adaptive execution splits.

    A filter on `path` would look answers up a second time, below; filter on `error` for those that have one."""
    cleaned = answers.withColumn("answer", F.when(F.col("error").isNull(), clean_response(F.col("raw_response"))))
    found = match_answers(cleaned.select("answer"), index).withColumnRenamed("tier", "match_tier")
    return cleaned.join(found, "answer", "left").select(*cleaned.columns, "path", "match_tier")


def cache_rows(labelled: DataFrame, version: Column | str, at: Column | None = None) -> DataFrame:
    """Cache entries (`schemas.CACHE`) of successful classifications; needs `content_hash`."""
    return labelled.filter("error is null").select(
        F.col("obj_key").alias("obj_token"),
        "content_hash",
        (F.lit(version) if isinstance(version, str) else version).alias("taxonomy_version"),
        "path",
        tag_json(path_parts(F.col("path"))).alias("tag_json"),
        (F.current_timestamp() if at is None else at).alias("updated_at"),
    )


def classification_counts() -> list[Column]:
    """Aggregates over documents with `read_status`, `path` and `cached_path`."""
    sent = F.col("read_status") == "ok"
    return [
        F.count_if(sent).alias("total"),
        F.count_if(sent & F.col("path").isNotNull()).alias("ok"),
        F.count_if(sent & F.col("path").isNull()).alias("failed"),
        F.count_if(F.col("cached_path").isNotNull()).alias("cached"),
        F.count_if(~sent).alias("empty"),
    ]


def classify_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counts over documents with `read_status`, `path` and `cached_path`."""
    return outcomes.agg(*classification_counts())
