"""Exact nearest neighbours by squared Euclidean distance, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bound_batches

#: Rows of a block of queries and of one of vectors, queries compared at once. A row that pairs two blocks has megabytes:
#: Arrow batches are bounded by bytes.
QUERY_ROWS, BLOCK_ROWS, AT_ONCE = 4096, 4096, 256
#: Query blocks are broadcast up to so many bytes, counted; beyond, they are dealt by salted keys.
BROADCAST_BYTES = 64 << 20

_BLOCK = pa.schema([("ids", pa.binary()), ("vectors", pa.binary())])
_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                if n and n + part.num_rows > rows:
                    yield packed(ids, values)
                    ids, values, n = [], [], 0
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                values.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes())
                n += part.num_rows
        if n:
            yield packed(ids, values)

    def packed(ids: list[bytes], values: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(ids)]), pa.array([b"".join(values)])], schema=_BLOCK)

    return run


def _closest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of each query's k nearest of a block. A matrix product tells which may be among them, up
    to its rounding; only their distances are computed from the differences, as the result has them."""
    size, length = np.square(v).sum(axis=1), np.square(q).sum(axis=1)
    rough = q @ v.T
    rough *= -2
    rough += size
    rough += length[:, None]
    slack = 1e-12 * q.shape[1] * (length + size.max())
    out = []
    for i, a in enumerate(q_ids.tolist()):
        d = rough[i]
        d[ids == a] = np.inf  # all vectors are finite
        # where squares overflow, distances don't tell apart in the product: all are computed
        limit = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1] + slack[i]
        may = np.flatnonzero((d <= limit) & (ids != a)) if np.isfinite(limit) else np.flatnonzero(ids != a)
        exact = np.square(v[may] - q[i]).sum(axis=1)
        may, exact = may[exact < np.inf], exact[exact < np.inf]
        near = np.lexsort((ids[may], exact))[:k]
        out += [(a, b, s) for b, s in zip(ids[may[near]].tolist(), exact[near].tolist())]
    return out


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, v = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in enumerate((np.int64, np.float64, np.int64, np.float64)))
                q, v, rows = q.reshape(len(q_ids), -1), v.reshape(len(ids), -1), []
                for lo in range(0, len(q_ids), AT_ONCE):
                    rows += _closest(q_ids[lo : lo + AT_ONCE], q[lo : lo + AT_ONCE], ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, _NEAR.types)], schema=_NEAR)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, distance``: the k nearest other rows of each row that ``is_query`` picks, ties to the
    smaller id. Vectors null, of another length than most, or holding null or non-finite components take no part."""
    bound_batches(vectors.sparkSession)
    size = vectors.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").filter("d > 0").first()
    whole = F.col(id_col).isNotNull() & (F.size(vector_col) == (size["d"] if size else 0)) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(whole)
    chosen = rows.filter(is_query).select(F.col(id_col).cast("long").alias("i"), vector_col)
    n = chosen.count()
    n_blocks, groups = max(1, -(-n // QUERY_ROWS)), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = chosen.repartition(n_blocks).mapInArrow(_pack(QUERY_ROWS), "ids binary, vectors binary").toDF("q_ids", "q_vectors").withColumn("_g", F.lit(0))
    blocks = rows.select(F.col(id_col).cast("long").alias("i"), vector_col).mapInArrow(_pack(BLOCK_ROWS), "ids binary, vectors binary")
    if n * 8 * (size["d"] if size else 0) <= BROADCAST_BYTES:
        pairs = blocks.withColumn("_g", F.lit(0)).join(F.broadcast(queries), "_g")
    else:
        blocks = blocks.withColumn("_g", F.pmod(F.xxhash64("ids"), F.lit(groups)))
        pairs = blocks.join(queries.drop("_g").withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "_g")
    near = pairs.select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(_nearest(k), "query_id long, vec_id long, distance double")
    ranked = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def passages(found: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """``found`` with the other columns of ``docs``, null where the key has no row. Of ``docs``, whose texts are long, only
    rows that were found are shuffled: their keys are counted, and broadcast where they fit the bound."""
    keys = found.select(F.col(key).alias("_key")).distinct()
    side = F.broadcast(keys) if keys.count() * 16 <= BROADCAST_BYTES else keys
    wanted = docs.join(side, docs[key] == side["_key"], "left_semi")
    return found.join(wanted, key, "left")
