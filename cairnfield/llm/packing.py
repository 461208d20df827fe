"""Bounded-space online packing of documents into sequences of at most ``LENGTH`` tokens.

Each partition keeps at most ``OPEN`` windows open. A document's whole windows are emitted at once; its rest goes into
the open window it fits best. Where none fits, the fullest window is emitted and a new one opened. Windows still open
when a partition ends are merged with those of neighbouring partitions: their pieces by best fit in falling order of
length, or whole windows where that takes fewer, a bounded number at a time.

Defined results: a null text is empty and is the end token alone; an empty table gives no rows; repeated rows are
packed each; a null doc_id stays null. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage, small_side, stage_table
from .tokens import documents_ids, vocabulary_path

LENGTH = 1024
OPEN = 64
#: Partitions whose open windows are merged together.
MERGED = 64

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left_open boolean"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left_open", pa.bool_())]


class Windows:
    """The open windows of a partition, sorted by free space; numbers and fills, not tokens."""

    def __init__(self, first: int, length: int = LENGTH, most: int = OPEN) -> None:
        self.length, self.most, self.next = length, most, first
        self.open: list[tuple[int, int]] = []  # (free, number), sorted

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int, int | None]:
        """(window, offset, window emitted for lack of room or None) for a piece of n < length tokens."""
        i, emitted = bisect.bisect_left(self.open, (n, -1)), None
        if i < len(self.open):
            free, w = self.open.pop(i)
        else:
            if len(self.open) == self.most:
                emitted = self.open.pop(0)[1]
            free, w = self.length, self.fresh()
        if free > n:
            bisect.insort(self.open, (free - n, w))
        return w, self.length - free, emitted


def pieces_of(n: int, length: int, windows: Windows) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, window, offset) of the pieces of a document of n tokens."""
    whole = n - n % length
    for start in range(0, whole, length):
        yield start, length, windows.fresh(), 0
    if n > whole:
        w, offset, _ = windows.place(n - whole)
        yield whole, n - whole, w, offset


def _pack(path: str, length: int, most: int, keep_ids: bool):
    schema = pa.schema(_FIELDS + [("ids", pa.binary())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId() << 33, length, most)
        held: dict[int, list[tuple]] = {}
        done: list[tuple] = []
        for batch in batches:
            for doc, ids in documents_ids(batch, path):
                for start, n, w, offset in pieces_of(len(ids), length, windows):
                    part = ids[start : start + n].tobytes()
                    held.setdefault(w, []).append((doc, start, n, zlib.crc32(part), len(ids), w, offset, False, *([part] * keep_ids)))
            still = {w for _, w in windows.open}
            done += [p for w in held.keys() - still for p in held.pop(w)]
            if done:
                yield _batch(done, schema)
                done = []
        left = [(*p[:7], True, *p[8:]) for ps in held.values() for p in ps]
        if left:
            yield _batch(left, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def best_fit_merge(fills: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(window, window it goes to, base offset) for windows (number, fill), by best fit in falling order of fill."""
    out, free = [], []
    for w, n in sorted(fills, key=lambda x: (-x[1], x[0])):
        i = bisect.bisect_left(free, (n, -1))
        if i < len(free):
            room, to = free.pop(i)
        else:
            room, to = length, w
        out.append((w, to, length - room))
        if room > n:
            bisect.insort(free, (room - n, to))
    return out


def merge_pieces(pieces: list[tuple[int, int, int]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(window, offset, window it goes to, offset there) for pieces (window, offset, length), in no more windows."""
    fills = Counter()
    for w, _, n in pieces:
        fills[w] += n
    numbers, whole = sorted(fills), best_fit_merge(list(fills.items()), length)
    alone = best_fit_merge([(i, n) for i, (_, _, n) in enumerate(pieces)], length)
    to_of = {to: k for k, to in enumerate(dict.fromkeys(to for _, to, _ in alone))}
    if len(to_of) <= len({to for _, to, _ in whole}):
        return [(*pieces[i][:2], numbers[to_of[to]], base) for i, to, base in alone]
    moves = {w: (to, base) for w, to, base in whole}
    return [(w, at, moves[w][0], moves[w][1] + at) for w, at, _ in pieces]


def _merge(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = merge_pieces(sorted(zip(pdf["sequence_id"].tolist(), pdf["offset"].tolist(), pdf["length"].tolist())), length)
        return pd.DataFrame(np.array(rows, np.int64).reshape(-1, 4), columns=["_from", "_at", "_to", "_base"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = OPEN, keep_ids: bool = True, path: str | None = None) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``keep_ids``, the piece's ``ids`` (little-endian unsigned 32-bit). Sequence numbers are unique, not dense."""
    bound_batches(docs.sparkSession)
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stage_table(rows.mapInArrow(_pack(path, length, most, keep_ids), _PIECE + ", ids binary" * keep_ids), "pieces")
    left = pieces.filter("left_open")
    group = F.floor(F.shiftright(F.col("sequence_id"), 33) / F.lit(MERGED))
    moves = stage_table(left.select("sequence_id", "offset", "length", group.alias("_g")).groupBy("_g").applyInPandas(_merge(length), "_from long, _at long, _to long, _base long"), "moves")
    moves = small_side(moves, moves.staged_rows, 48)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "left_open")]
    moved = left.join(moves, (left["sequence_id"] == moves["_from"]) & (left["offset"] == moves["_at"])).select(*columns, F.col("_to").alias("sequence_id"), F.col("_base").alias("offset"))
    return pieces.filter("not left_open").select(*columns, "sequence_id", "offset").unionByName(moved)
