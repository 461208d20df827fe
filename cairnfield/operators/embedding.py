"""Embedding of chunks: an injectable function in batches, documents whose chunks have not changed skipped, vectors
replaced by document.

The default embedder hashes words into signed dimensions (no model, no network), so results are the same anywhere; any
other is given by a factory, called once in each task that embeds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bound_batches
from .incremental import to_embed, upsert

BATCH = 64
DIMENSIONS = 256
#: Words whose hashes a task keeps from one batch to the next.
KNOWN = 1 << 17
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Texts to a matrix, a row each.
Embedder = Callable[[list[str]], np.ndarray]


def word_hash(word: bytes) -> int:
    """The first 32 bits of a word's md5."""
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big")


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Each word, A-Z lower-cased, adds 1 or -1 to the dimension its hash names; vectors have length 1, or 0 if the text
    has no word or its words cancel out."""

    known: dict[bytes, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        words = [WORD.findall(t.encode().translate(LOWER)) for t in texts]
        if len(known) > KNOWN:
            known.clear()
        for w in set().union(*words) - known.keys():
            known[w] = word_hash(w)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        h = np.array([known[w] for ws in words for w in ws], np.int64)
        sign = np.where(h // dimensions % 2, -1.0, 1.0)
        out = np.bincount(row * dimensions + h % dimensions, sign, len(texts) * dimensions).astype(float).reshape(len(texts), dimensions)
        size = np.sqrt(np.square(out).sum(axis=1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    return embed


def with_embeddings(chunks: DataFrame, text: str = "text", make: Callable[[], Embedder] = hashing_embedder, out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``chunks`` with ``out``, the vector of each text; a null text is empty. ``make`` gives the embedder, which gets at
    most ``batch`` texts at a time and must give as many rows."""
    if batch < 1:
        raise ValueError("batch must be 1 or more")

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = make()
        for texts in parts:
            rows: list[pa.Array] = []
            for lo in range(0, len(texts), batch):
                some = [t or "" for t in texts.slice(lo, batch).to_pylist()]
                found = np.ascontiguousarray(embed(some), dtype=float)
                if found.ndim != 2 or len(found) != len(some):
                    raise ValueError(f"the embedder gave {found.shape} for {len(some)} texts")
                ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
                rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.reshape(-1), pa.float64())))
            yield pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.float64()))

    bound_batches(chunks.sparkSession)
    return chunks.withColumn(out, run(F.col(text)))


def embed_changed(chunks: DataFrame, files: DataFrame, manifest: DataFrame, store: DataFrame, make: Callable[[], Embedder] = hashing_embedder, batch: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, manifest, rows embedded) after a run.

    ``files``: ``source_stem, mtime`` of the chunk files, one row a stem; ``chunks``: ``source_stem, chunk_id, text``;
    ``manifest``: ``source_stem, status, embedded_count, chunks_mtime_unix``; ``store``: ``source_stem, chunk_id,
    embedding``. Stems whose file is as new as the manifest says are skipped; those of the others are replaced as a
    whole, so a run repeated changes nothing. A stem without a chunk loses its vectors and is ``skipped_empty``."""
    wanted = to_embed(files, manifest, "source_stem", "mtime")
    some = chunks.join(wanted.select("source_stem"), "source_stem", "left_semi")
    fresh = with_embeddings(some, make=make, batch=batch).select("source_stem", "chunk_id", "embedding")
    after = store.join(wanted.select("source_stem"), "source_stem", "left_anti").unionByName(fresh)
    counts = some.groupBy("source_stem").agg(F.count("*").alias("n"))
    told = wanted.join(counts, "source_stem", "left").select("source_stem", F.when(F.col("n") > 0, "embedded").otherwise("skipped_empty").alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("embedded_count"), F.col("mtime").cast("double").alias("chunks_mtime_unix"))
    rows = upsert(manifest.withColumn("_o", F.lit(0)), told.withColumn("_o", F.lit(1)), "source_stem", "_o").drop("_o")
    return after, rows, told
