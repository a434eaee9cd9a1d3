"""What is sent to the Python workers that call the model."""

import weakref

import pandas as pd

from docgrove.operators import classify
from docgrove.plans import run as runs
from docgrove.scratch import batch_bytes
from workload.spark_queries import QUERIES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_in_bytes_while_written(spark, tmp_path):
    def size(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)], "size": [int(batch["t"].str.len().sum())]})

    rows = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 2000) AS t").mapInPandas(size, "n long, size long")
    before = spark.conf.get(KEY, None)
    with batch_bytes(spark, 1 << 20):
        rows.write.parquet(str(tmp_path / "a"))
        with batch_bytes(spark, 1 << 30):  # the smaller bound stays
            assert spark.conf.get(KEY) == str(1 << 20)
    assert spark.conf.get(KEY, None) == before
    got = spark.read.parquet(str(tmp_path / "a")).collect()
    assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 2 << 20


def test_a_run_bounds_the_batches_of_its_model_calls(spark, sf, monkeypatch):
    seen, plain = {}, runs.stage
    before = spark.conf.get(KEY, None)

    def stage(df, folder):
        seen[folder.rsplit("/", 2)[-2]] = spark.conf.get(KEY, None)
        return plain(df, folder)

    monkeypatch.setattr(runs, "stage", stage)
    assert QUERIES["end_to_end"](spark, sf).count()
    assert seen["answers"] == str(classify.BATCH_BYTES) and seen["labelled"] == before


def test_a_batch_is_let_go_before_the_next_is_read():
    alive = []

    def batches():
        for n in range(3):
            assert all(r() is None for r in alive)
            batch = pd.DataFrame({"obj_key": [f"{n}a", f"{n}b"], "text": ["t", "u"]})
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    assert [k for k, _ in classify._filled(batches(), str.upper)] == ["0a", "0b", "1a", "1b", "2a", "2b"]
