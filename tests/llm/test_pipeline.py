import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from cairnfield.llm import langid, mixing, tokens, toxicity

from . import brute


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage's rows against a plain computation over its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id"))
    extra = spark.createDataFrame([(90001, "12 34", None, None, 5), (90002, None, "en", "src0", None)], docs.schema)
    docs = docs.unionByName(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "ngram_join", "mixing", "packing"]
    before, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf_dir)
        at[name] = (before, out := spark.createDataFrame(out.collect(), out.schema))
        assert name == "packing" or out.columns == docs.columns
        before = out

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b = at["language_id"]
    assert ids(b) == sorted(r.doc_id for r in a.collect() if r.text and any(map(str.isalpha, r.text)))
    assert {90001, 90002}.isdisjoint(ids(b))

    a, b = at["toxicity"]
    model = toxicity.fit(a, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(model.words, model.stems)
    assert ids(b) == sorted(r.doc_id for r in a.collect() if toxicity.score_text(model, scorer, r.text) < 0.5)

    a, b = at["ngram_join"]
    assert ids(b) == sorted(i for i, n, c in brute.components([(r.doc_id, r.text) for r in a.collect()]) if not n or i == c)

    a, b = at["mixing"]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(a).collect() if r.size}
    counts = {r.doc_id: r.n for r in b.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: k for i, k in taken.items() if k}

    a, b = at["packing"]
    encoder = tokens.encoder(tokens.vocabulary_path())
    want = {r.doc_id: np.append(encoder.encode(r.text), np.uint32(0)) for r in a.collect()}
    pieces = b.collect()
    assert sum(p.length for p in pieces) == sum(len(want[r.doc_id]) for r in a.collect())
    for p in pieces:
        part = want[p.doc_id][p.start : p.start + p.length].tobytes()
        assert bytes(p.ids) == part and p.ids_crc32 == zlib.crc32(part)
    assert langid.UND == "und" and corpus_pipeline.ORACLE_SQL is None


def test_run_returns_the_last_stage(spark, tmp_path, sf_dir):
    for t in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{sf_dir}/{t}.parquet").slice(0, 120), tmp_path / f"{t}.parquet")
    assert "sequence_id" in corpus_pipeline.run(spark, str(tmp_path)).columns


def test_empty_documents_and_null_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in ([], [(None, "some words here", "en", None, 3), (None, "some words here", "en", None, 3), (None, None, None, None, None)]):
        at = spark.createDataFrame(rows, docs.schema)
        for name, stage in corpus_pipeline.STAGES[1:]:  # without labelled rows no language is known
            at = spark.createDataFrame((out := stage(spark, at, sf_dir)).collect(), out.schema)
            assert name == "packing" or at.columns == docs.columns
        assert (at.count() > 0) == bool(rows)
    assert corpus_pipeline.identify_language(spark, docs.limit(0), sf_dir).count() == 0
