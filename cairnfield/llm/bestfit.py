"""Token-id output: best-fit-decreasing packing with a segment tree over capacities.

Documents are tokenized and packed a group at a time (``GROUP_DOCS`` documents or ``GROUP_TOKENS`` tokens of a
partition). An overlong document is split into whole sequences, written as they are, and a rest, losslessly. Rests go,
longest first, into the fullest sequence with room; the segment tree finds the least sufficient capacity. A sequence is
a row of a Parquet table in the shared folder: padded ids, cumulative segment lengths, position resets, segments.

Defined results: a null text is the end token alone; repeated rows are packed each; a null doc_id stays null; an empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage_table
from .tokens import documents_ids, vocabulary_path

LENGTH = 1024
GROUP_DOCS = 4096
GROUP_TOKENS = 2 << 20
#: Sequences in a batch that leaves a worker.
OUT_ROWS = 512

_SEGMENT = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64())]))
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("segments", _SEGMENT)])
_DDL = "sequence_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, segments array<struct<doc_id: long, start: long, length: int, doc_tokens: long>>"


class CapacityTree:
    """Counts of bins by free capacity in a segment tree; finds the least capacity >= n that some bin has."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, capacity: int, b: int) -> None:
        self.bins[capacity].append(b)
        self._add(capacity, 1)

    def pop(self, n: int) -> tuple[int, int] | None:
        """(capacity, bin) of a fullest bin with room for n, taken out; None if there is none."""
        i = self.size + n
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:  # up until a right sibling has some
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:  # down to its leftmost
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of indices into ``sizes`` (each 1 to ``length``), filled longest first, ties by index."""
    tree, bins = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.pop(sizes[i])
        if found is None:
            found = length, len(bins)
            bins.append([])
        bins[found[1]].append(i)
        if found[0] > sizes[i]:
            tree.push(found[0] - sizes[i], found[1])
    return bins


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    """The matrix's rows as binary values, without a copy."""
    n, width = matrix.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 4 * width, 4 * width, dtype=np.int32)), pa.py_buffer(matrix)])


def _group_rows(group: list[tuple], first: int, length: int) -> pa.RecordBatch:
    """The sequences of a group of (doc_id, ids): whole ones first, as they come, then the packed rests."""
    docs, tokens = pa.array([d for d, _ in group], pa.int64()), np.array([len(x) for _, x in group], np.int64)
    ids, at = np.concatenate([x for _, x in group]), np.cumsum(tokens) - tokens
    whole, rest = tokens // length, tokens % length
    n_whole, short = int(whole.sum()), np.flatnonzero(rest)
    bins = best_fit_decreasing(rest[short].tolist(), length)
    matrix = np.zeros((n_whole + len(bins), length), "<u4")
    row = 0
    for d in np.flatnonzero(whole).tolist():
        k = int(whole[d])
        matrix[row : row + k] = ids[at[d] : at[d] + k * length].reshape(k, length)
        row += k
    order = short[np.array([i for members in bins for i in members], np.int64)] if bins else short
    counts = np.concatenate([np.ones(n_whole, np.int64), np.array([len(members) for members in bins], np.int64)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    owner = np.concatenate([np.repeat(np.arange(len(group)), whole), order])
    start = np.concatenate([(np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)) * length, whole[order] * length])
    used = np.concatenate([np.full(n_whole, length), rest[order]])
    upto = np.concatenate([[0], np.cumsum(used)])
    within = upto[:-1] - np.repeat(upto[bounds[:-1]], counts)  # where each segment begins in its sequence
    sequence = np.repeat(np.arange(len(counts)), counts)
    for r, o, a, n in zip(*(x[n_whole:].tolist() for x in (sequence, within, at[owner] + start, used))):
        matrix[r, o : o + n] = ids[a : a + n]
    ends = np.zeros(len(owner) + len(counts), np.int64)  # of each sequence 0, then where each segment ends
    ends[np.arange(len(owner)) + sequence + 1] = within + used
    segments = pa.StructArray.from_arrays([docs.take(pa.array(owner)), pa.array(start), pa.array(used, pa.int32()), pa.array(tokens[owner])], names=["doc_id", "start", "length", "doc_tokens"])
    columns = [pa.array(np.arange(first, first + len(counts))), _rows_of(matrix), _lists(bounds + np.arange(len(bounds)), pa.array(ends, pa.int32())), _lists(bounds, pa.array(within, pa.int32())), _lists(bounds, segments)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _pack(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group, held = TaskContext.get().partitionId() << 33, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, group, held
            out = _group_rows(group, number, length)
            number, group, held = number + out.num_rows, [], 0
            yield from (out.slice(lo, OUT_ROWS) for lo in range(0, out.num_rows, OUT_ROWS))

        for batch in batches:
            for doc in documents_ids(batch, path):
                group.append(doc)
                held += len(doc[1])
                if len(group) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield from packed()
        if group:
            yield from packed()

    return run


def write_matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """The written table: ``sequence_id, ids`` (``length`` little-endian unsigned 32-bit ids, padded with 0),
    ``cu_seqlens`` (from 0 to the tokens used), ``position_resets`` (where positions start again at 0), ``segments``."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(_pack(path or vocabulary_path(), length), _DDL), "matrices")


_PIECES = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "position_end")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments = batch.column(4).flatten()
        counts = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
        resets = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        lengths = segments.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.delete(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(counts + 1) - counts - 1)
        row = np.repeat(np.arange(batch.num_rows), counts).tolist()
        ids = [memoryview(x.as_buffer()) for x in batch.column(1)]
        crcs = [zlib.crc32(ids[r][4 * a : 4 * b]) for r, a, b in zip(row, resets.tolist(), ends.tolist())]
        sequence = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        columns = [segments.field("doc_id"), segments.field("start"), lengths, crcs, segments.field("doc_tokens"), sequence, resets, ends - 1 - resets]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=pa.schema(_PIECES))


def read_pieces(matrices: DataFrame) -> DataFrame:
    """A row for each segment of the written sequences, from their ids: where it lies, its crc and last position."""
    return matrices.mapInArrow(_read, ", ".join(f"{n} long" for n, _ in _PIECES))
