"""Batches that Python tasks get and give are bounded in rows and bytes, whatever the input's rows hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnfield import storage
from cairnfield.operators import chunking, vectors


@pytest.fixture
def batches_of(spark):
    names = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("10000", str(256 << 20))):
        spark.conf.set(n, v)
    yield lambda: [int(spark.conf.get(n).removesuffix("B").removesuffix("b")) for n in names]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_batches_of_texts_and_blocks(spark, batches_of):
    docs = spark.createDataFrame([(1, "a b")], "stem long, text string")
    chunking.section_chunks(docs, "stem", "text").collect()
    assert batches_of() == [storage.BATCH_ROWS, storage.BATCH_BYTES]


def test_batches_of_pairs_of_blocks(spark, batches_of):
    rows = spark.range(3).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("embedding"))
    assert vectors.nearest(rows, F.col("vec_id") == 0, k=1).collect()[0]["vec_id"] == 1
    assert batches_of() == [storage.BATCH_ROWS, storage.BATCH_BYTES]


def test_chunks_of_one_long_text(spark):
    text = "word " * 600_000
    rows = chunking.section_chunks(spark.createDataFrame([(1, text)], "stem long, text string"), "stem", "text").orderBy("chunk_index").collect()
    assert len(rows) > storage.BATCH_ROWS and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e160])
def test_block_distances_are_those_of_the_differences(scale):
    r = np.random.default_rng(1)
    v = np.concatenate([r.integers(-2, 3, (40, 8)).astype(float), np.zeros((5, 8)), 1 + 1e-9 * r.standard_normal((20, 8))]) * scale
    ids = r.permutation(len(v))
    with np.errstate(all="ignore"):
        got = vectors._closest(ids, v, ids, v, 6)
        want = []
        for a, x in zip(ids.tolist(), v):
            d = np.square(v - x).sum(axis=1)
            want += [(a, b, s) for s, b in sorted((s, b) for s, b in zip(d.tolist(), ids.tolist()) if b != a and s < np.inf)[:6]]
    assert got == want


def test_blocks_are_filled_over_batches():
    parts = [pa.RecordBatch.from_pydict({"i": list(range(k, k + 3)), "v": [[float(j)] for j in range(k, k + 3)]}) for k in (0, 3, 6)]
    found = [np.frombuffer(b.column(0)[0].as_py(), np.int64).tolist() for b in vectors._pack(6)(iter(parts))]
    assert found == [[0, 1, 2, 3, 4, 5], [6, 7, 8]]
