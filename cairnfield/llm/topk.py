"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows. Candidates are cut into blocks, each an inverted index (term -> rows, weights); a
block of queries runs over a block of candidates one term at a time, scattering ``query weight * posting weight`` into
dense score arrays. Each pair of blocks keeps its k best by partition selection; a ranked window merges them.

Defined results: rows with a null id or vector, or with a null or non-finite component, take no part. Missing
components of a shorter vector are 0. Query rows that repeat an id count once (the least vector, in array order, if
they differ); repeated candidate rows each count. Scores beyond a long are clamped to it. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side

BLOCK_ROWS = 4096
QUERY_ROWS = 512
TILE = 32
LONG = np.iinfo(np.int64)
_SAFE = float(1 << 62)

_BLOCK = "ids binary, terms binary, starts binary, rows binary, weights binary"


def valid_vector(c: str):
    """Native test: not null, and each component not null and finite."""
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _pack(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> dict[str, bytes]:
    """An inverted index of one block: postings by term, zero weights left out; rows are empty where a term has all."""
    n = len(ids)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    keep = values != 0
    term, row, values = term[keep], row[keep], values[keep]
    order = np.argsort(term, kind="stable")
    term, row, values = term[order], row[order], values[order]
    terms, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term)).astype(np.int64)
    full = np.repeat(np.diff(starts) == n, np.diff(starts))
    return {"ids": ids.tobytes(), "terms": terms.astype(np.int64).tobytes(), "starts": starts.tobytes(), "rows": np.where(full, -1, row).astype(np.int32).tobytes(), "weights": values.tobytes()}


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, limit):
                part = batch.slice(lo, limit)
                vectors = part.column(1)
                values = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pylist([_pack(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes, values)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([(n, pa.binary()) for n in ("ids", "terms", "starts", "rows", "weights")])
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class _Index:
    """A block, unpacked: ``postings[t] = (rows or None for all rows, weights)``."""

    def __init__(self, rec: dict[str, bytes]) -> None:
        self.ids = np.frombuffer(rec["ids"], np.int64)
        starts, rows = np.frombuffer(rec["starts"], np.int64), np.frombuffer(rec["rows"], np.int32)
        weights = np.frombuffer(rec["weights"], np.float64)
        self.most = float(np.abs(weights).max(initial=0))
        self.postings = {}
        for t, a, b in zip(np.frombuffer(rec["terms"], np.int64).tolist(), starts[:-1].tolist(), starts[1:].tolist()):
            self.postings[t] = (None if rows[a] < 0 else rows[a:b], weights[a:b])


def _accumulate(q: _Index, c: _Index) -> np.ndarray:
    """Scores of all queries against all candidates of two blocks, term by term."""
    shared = [t for t in q.postings if t in c.postings]
    exact = q.most * c.most * max(1, len(shared)) < _SAFE
    whole = (lambda w: w.astype(np.int64)) if exact else (lambda w: np.array([int(x) for x in w], dtype=object))
    score = np.zeros((len(q.ids), len(c.ids)), dtype=np.int64 if exact else object)
    q_side = {t: (q.postings[t][0], whole(q.postings[t][1])) for t in shared}
    c_side = {t: (c.postings[t][0], whole(c.postings[t][1])) for t in shared}
    for lo in range(0, len(q.ids), TILE):
        tile = score[lo : lo + TILE]
        for t in shared:
            q_rows, q_w = q_side[t]
            c_rows, c_w = c_side[t]
            if q_rows is None:
                at, w = np.arange(len(tile)), q_w[lo : lo + TILE]
            else:
                a, b = np.searchsorted(q_rows, (lo, lo + TILE))
                at, w = q_rows[a:b] - lo, q_w[a:b]
            for i, x in zip(at.tolist(), w):
                if c_rows is None:
                    tile[i] += x * c_w
                else:
                    tile[i, c_rows] += x * c_w  # a row has a term once, so no index repeats
    if not exact:
        score = np.array([[min(max(x, LONG.min), LONG.max) for x in row] for row in score.tolist()], dtype=np.int64).reshape(score.shape)
    return score


def _select(score: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Partition selection: of each query's row, the k best other candidates, ties to smaller ids."""
    out_q, out_c, out_s = [], [], []
    for i, q in enumerate(q_ids):
        others = np.flatnonzero(c_ids != q)
        s = score[i, others]
        if len(s) > k:
            kth = np.partition(s, len(s) - k)[len(s) - k]
            keep = np.flatnonzero(s >= kth)
            others, s = others[keep], s[keep]
        best = np.lexsort((c_ids[others], -s.astype(np.float64), ~s))[:k]
        out_q.append(np.full(len(best), q))
        out_c.append(c_ids[others[best]])
        out_s.append(s[best])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_q, out_c, out_s))


def _score(k: int):
    names = ["ids", "terms", "starts", "rows", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                q, c = _Index({n: rec[f"q_{n}"] for n in names}), _Index({n: rec[n] for n in names})
                found = _select(_accumulate(q, c), q.ids, c.ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], schema=_OUT)

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products over all other rows.

    ``is_query`` is a Column over ``vectors``. Query blocks (512 rows each) meet candidate blocks (4,096 rows each) by a
    join on the query block's number, broadcast only within the size bound; beyond it each candidate block goes once to
    one of so many groups as there are shuffle partitions, and the query blocks to all. No task holds more than two blocks
    at a time."""
    spark = vectors.sparkSession
    usable = vectors.filter(F.col(id_col).isNotNull() & valid_vector(vector_col))
    queries = usable.filter(is_query).select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).groupBy("_id").agg(F.min("_v").alias("_v"))
    sized = queries.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("d")).first()
    n_blocks = max(1, -(-sized["n"] // QUERY_ROWS))
    q_blocks = queries.repartition(n_blocks).mapInArrow(_blocks(QUERY_ROWS), _BLOCK)
    q_blocks = q_blocks.select(F.pmod(F.xxhash64("ids"), F.lit(n_blocks)).alias("_qb"), *(F.col(n).alias(f"q_{n}") for n in _SCHEMA.names))
    blocks = usable.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).mapInArrow(_blocks(BLOCK_ROWS), _BLOCK)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = small_side(q_blocks, sized["n"], 12 * (sized["d"] or 1))
    if small is not q_blocks:
        pairs = blocks.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(small, "_qb")
    else:
        grouped = blocks.withColumn("_g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
        pairs = grouped.join(q_blocks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "_g")
    best = pairs.select(*_SCHEMA.names, *(f"q_{n}" for n in _SCHEMA.names)).mapInArrow(_score(k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
