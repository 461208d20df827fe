"""Embedding of chunks: the default embedder, injected ones, incremental runs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import embedding


def plainly(text, d):
    v = [0] * d
    for w in (text or "").split():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % d] += -1 if h // d % 2 else 1
    n = sum(x * x for x in v) ** 0.5
    return [x / n if n else 0.0 for x in v]


def test_default_vectors(spark):
    texts = ["A b  c", "a B c", "", None, "  \n", "x " * 500, "Ünï code", "a"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, text string, word string")
    got = {r.i: r.embedding for r in embedding.with_embeddings(df, make=lambda: embedding.hashing_embedder(16)).collect()}
    assert got == {i: pytest.approx(plainly(t, 16)) for i, t in enumerate(texts)}
    assert got[0] == got[1] and len(embedding.with_embeddings(df).first().embedding) == embedding.DIMENSIONS


def test_an_injected_embedder_is_made_once_a_task_and_gets_batches(spark):
    def make():
        calls = []

        def embed(texts):
            calls.append(len(texts))
            return np.array([[len(t), len(texts), len(calls)] for t in texts])

        return embed

    df = spark.range(150).select("id", F.lit("abc").alias("text")).coalesce(1)
    got = embedding.with_embeddings(df, make=make, batch=64).collect()
    assert sorted({(r.embedding[1], r.embedding[2]) for r in got}) == [(22.0, 3.0), (64.0, 1.0), (64.0, 2.0)]
    with pytest.raises(ValueError):
        embedding.with_embeddings(df, batch=0)
    with pytest.raises(Exception, match="the embedder gave"):
        embedding.with_embeddings(df, make=lambda: lambda texts: np.zeros((1, 2))).collect()


def test_runs(spark):
    """A document changed, one new, one emptied, one as it was; then the run again."""
    def chunks(**texts):
        return spark.createDataFrame([(s, f"{s}:{i}", t) for s, ts in texts.items() for i, t in enumerate(ts)], "source_stem string, chunk_id string, text string")

    def files(**times):
        return spark.createDataFrame(list(times.items()), "source_stem string, mtime double")

    none = spark.createDataFrame([], "source_stem string, status string, embedded_count long, chunks_mtime_unix double")
    empty = spark.createDataFrame([], "source_stem string, chunk_id string, embedding array<double>")
    store, manifest, told = embedding.embed_changed(chunks(a=["x", "y"], b=["z"], c=["u"]), files(a=1.0, b=1.0, c=1.0), none, empty)
    assert told.count() == 3 and store.count() == 4
    now, times = chunks(a=["new"], c=["u"], d=["v", "w"]), files(a=2.0, b=2.0, c=1.0, d=1.0)
    store, manifest, told = embedding.embed_changed(now, times, manifest, store)
    assert {r.chunk_id for r in store.collect()} == {"a:0", "c:0", "d:0", "d:1"}
    assert {(r.source_stem, r.status, r.embedded_count, r.chunks_mtime_unix) for r in manifest.collect()} == {("a", "embedded", 1, 2.0), ("b", "skipped_empty", 0, 2.0), ("c", "embedded", 1, 1.0), ("d", "embedded", 2, 1.0)}
    assert {r.source_stem for r in told.collect()} == {"a", "b", "d"}
    again, rows, nothing = embedding.embed_changed(now, times, manifest, store)
    assert nothing.count() == 0
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(again) == as_set(store) and as_set(rows.select(manifest.columns)) == as_set(manifest)


def test_words_are_hashed_once_a_task(monkeypatch):
    seen = []
    real = embedding.word_hash
    monkeypatch.setattr(embedding, "word_hash", lambda w: seen.append(w) or real(w))
    embed = embedding.hashing_embedder(16)
    first, again = embed(["a b A", "", "c"]), embed(["c a", "b"])
    assert sorted(seen) == [b"a", b"b", b"c"] and first.shape == (3, 16) and not first[1].any()
    assert np.array_equal(again[1], embedding.hashing_embedder(16)(["b"])[0])
