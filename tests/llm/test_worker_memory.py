"""What tasks leave behind in the Python workers that later tasks are given."""

import numpy as np
import pyarrow as pa
import pytest

from docgrove.llm import harmonic_packing, jaccard_join


def test_packing_leaves_no_vocabulary_in_a_worker(spark, docs):
    def held(batches):
        for _ in batches:
            sizes = [f.cache_info().currsize for f in (harmonic_packing._fast, harmonic_packing._exact)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)])], ["n"])

    assert harmonic_packing.pack(docs).count()
    assert not any(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect())


@pytest.mark.parametrize("plain", [[], [2], [0, 2, 4], range(5)])
def test_counts_are_read_out_of_their_column(plain):
    """Rows without counts and columns in slices and chunks."""
    rows = [b"" if i in plain else jaccard_join._bins(np.arange(1, 40, dtype=np.uint64) << np.uint64(50 + i)) for i in range(5)]
    for column in (pa.chunked_array([rows], pa.binary()), pa.chunked_array([rows[:2], rows[2:]], pa.binary()), pa.chunked_array([[b"x", *rows]], pa.binary())[1:]):
        exact, counts = jaccard_join._counts(column)
        assert exact.tolist() == [bool(r) for r in rows]
        assert counts.tobytes() == b"".join(r or bytes(jaccard_join.BINS) for r in rows)
