"""N-gram Jaccard self-join, size-aware: heavy and light sets, then connected components.

Documents are sets of word shingles; two link when their Jaccard similarity is at least ``NUM / DEN``. Shingles have
one global order, rare before frequent, from a fixed-size count of all documents' shingles. Sets that link share
shingles early in that order: of the ``n - ceil(0.75 n) + 1`` first ones at least one, of one more at least two.

* A large set's prefix is a little longer, and its pairs must share as many signatures more, which leaves out sets
  that have no more than a passage in common.
* A small set enumerates the 2-subsets of its prefix as signatures; a large set has each prefix shingle in an inverted
  list. Sets near the boundary do both. The boundary is the size at which a cost model, over the sizes of all
  documents, is least.
* Pairs are verified in steps that lose no link: each set against the one it shares most with, then, in long lists,
  sets left over against several members of their family's largest component, then every pair of different components;
  families (sets joined by long lists) are scanned block by block, as a whole or list by list, whichever has fewer
  pairs, and only blocks of near sizes. Pairs within a component need no verification, so a family of thousands of near
  copies costs a few pairs a member.

Equal sets are one node throughout. Sets are verified exactly from their sorted shingle hashes.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import bound_batches, drop_stage, small_side, stage_counted, stage_table
from .components import components, extend
from .shingles import batch_sets, mix

NUM, DEN = 3, 4
#: Buckets of the shingle count.
BUCKET_BITS = 20
#: Rows the count is shuffled in.
CHUNK = 1 << 14
#: Largest boundary between small and large sets that is considered.
MOST_SMALL = 48
#: Cost of a verified candidate, in signatures, and share of candidates that two common shingles leave of one's.
VERIFY_COST, SUBSET_SHARE = 8.0, 0.25
#: A large set's prefix is longer by one in so many shingles; as many shared ones more are asked of its pairs.
MORE = 32
#: Sets in a list from which it counts as long; sets of a family's largest component tried by those outside; sets of
#: a block that is scanned whole.
LONG, TRIES, BLOCK = 32, 6, 256
#: Sets that are shuffled at a time to be compared, for each set there is.
TRAVEL = 2
#: Least and most bits of the filter of shared signatures, those that number a row of it, and its size by what it holds.
FILTER_BITS, MOST_FILTER_BITS, FILTER_ROWS, FILTER_SPARSE = 27, 29, 10, 32
#: Signatures that are sent together to be counted, and bits sent of each, those after its row's in the filter.
SENT, SENT_BITS = 1 << 20, 32
#: Least bits of the filter of the documents that hold a set for all with the same one.
HOLDER_BITS = 20

_DOC = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's id, set size and fingerprint; at the end the partition's shingle counts, in chunks."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        sets = list(batch_sets(batch.column(1)))
        if sets:
            total += np.bincount(bucket(np.concatenate(sets)), minlength=len(total))
        marks = [fingerprint(s) if len(s) else (None, None) for s in sets]
        none = [None] * len(sets)
        yield _batch([batch.column(0), [len(s) for s in sets], [h for h, _ in marks], [x for _, x in marks], none, none], _DOC)
    parts = [(k, total[k * CHUNK : (k + 1) * CHUNK].astype(np.uint32).tobytes()) for k in range(len(total) // CHUNK)] if total.any() else []
    none = [None] * len(parts)
    yield _batch([none, none, none, none, [k for k, _ in parts], [c for _, c in parts]], _DOC)


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK, np.int64)
    for batch in batches:
        for c in batch.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint32)
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def least_overlap(n: int) -> int:
    """Shingles a set of n shares with any set it links to, at least."""
    return -(-NUM * n // DEN)


def least_shared(n: int, most: int) -> int:
    """Signatures that a set shares with any other it links to, at least (of two sets, the less of both)."""
    return 1 if n <= most else 1 + n // MORE


def boundary(sizes: dict[int, int], per_list: float) -> int:
    """The size up to which sets enumerate subsets, of least cost. ``sizes``: documents by set size; ``per_list``:
    other sets in a shingle's list, on average."""

    def cost(most: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            prefix = n - least_overlap(n) + 1
            if n <= most:
                total += count * prefix * (prefix + 1) / 2 * (1 + VERIFY_COST * SUBSET_SHARE * per_list)
            if NUM * most < DEN * n:
                total += count * prefix * (1 + VERIFY_COST * per_list)
        return total

    return min(range(MOST_SMALL + 1), key=cost)


def signatures(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of a sorted set, with its shingles' bucket counts ``order``: subset hashes if small, prefix shingles if large."""
    n = len(s)
    key = (np.minimum(order, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (s >> np.uint64(24))
    long = n - least_overlap(n) + least_shared(n, most)
    first = s[np.argsort(key, kind="stable")[: max(long, n - least_overlap(n) + 2)]]
    out = []
    if n <= most and len(first) > 1:
        pairs = np.array(list(itertools.combinations(first[: n - least_overlap(n) + 2].tolist(), 2)), np.uint64)
        low, high = pairs.min(axis=1), pairs.max(axis=1)
        out.append((low * np.uint64(0x9E3779B97F4A7C15) ^ high) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    if NUM * most < DEN * n:
        out.append(first[:long])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def filter_width(lists: int, least: int = FILTER_BITS) -> int:
    """The filter's bits, a power of two, for so many shared signatures: up to ``MOST_FILTER_BITS`` few others pass."""
    return min(MOST_FILTER_BITS, max(least, (FILTER_SPARSE * lists).bit_length()))


def _bits(width: int):
    """A row of the filter of ``2 ** width`` bits: one for each shared signature."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << (width - FILTER_ROWS), np.uint8)
        for batch in batches:
            on[filter_bit(batch.column("sig").to_numpy().view(np.uint64), width) & (len(on) - 1)] = 1
        yield pa.RecordBatch.from_pydict({"row": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    return run


def _filter(sigs: DataFrame, width: int):
    """A broadcast filter of ``2 ** width`` bits that every ``sig`` passes: 16 MB at the least width."""
    return _gathered(sigs.select("sig", F.shiftrightunsigned("sig", 64 - FILTER_ROWS).alias("row")).groupBy("row").applyInArrow(_bits(width), "row long, bits binary"), width)


def _gathered(found: DataFrame, width: int):
    """The broadcast filter of the rows ``found`` (row, bits)."""
    rows = found.collect()
    row_bytes = 1 << (width - FILTER_ROWS - 3)
    bits = bytearray(row_bytes << FILTER_ROWS)
    while rows:
        r = rows.pop()
        bits[r["row"] * row_bytes : (r["row"] + 1) * row_bytes] = r["bits"]
    return found.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, sig: np.ndarray, width: int) -> np.ndarray:
    bit = filter_bit(sig, width)
    return bits[bit >> 3] >> (7 - (bit & 7)) & 1 == 1


def filter_bit(sig: np.ndarray, width: int) -> np.ndarray:
    return (sig >> np.uint64(64 - width)).astype(np.int64)


def _marks(ids: pa.Array) -> np.ndarray:
    """What the filter of holders knows a document by."""
    return mix(ids.fill_null(0).to_numpy().view(np.uint64))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"sig": pa.array(_marks(batch.column(0)).view(np.int64))})


def _holding(batches: Iterator[pa.RecordBatch], holders, width: int) -> Iterator[Iterator[np.ndarray]]:
    """The sets, a batch (doc_id, text) at a time, of the documents that pass the filter ``holders``: of equal sets one
    holder's, and few others."""
    bits = np.frombuffer(holders.value, np.uint8)
    for batch in batches:
        yield batch_sets(batch.filter(pa.array(passes(bits, _marks(batch.column(0)), width))).column(1))


def by_row(sigs: np.ndarray) -> pa.RecordBatch:
    """Rows (row, sigs): signatures by their row of the filter, of each the ``SENT_BITS`` bits that follow; one that comes
    often is there twice."""
    part = np.sort(sigs >> np.uint64(64 - FILTER_ROWS - SENT_BITS))
    part = part[np.concatenate([np.ones(min(2, len(part)), bool), part[2:] != part[:-2]])]
    ends = np.searchsorted(part, np.arange((1 << FILTER_ROWS) + 1).astype(np.uint64) << np.uint64(SENT_BITS))
    sent = pa.Array.from_buffers(pa.binary(), 1 << FILTER_ROWS, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(part.astype(np.uint32))])
    out = pa.RecordBatch.from_arrays([pa.array(range(1 << FILTER_ROWS), pa.int64()), sent], ["row", "sigs"])
    return out.filter(pa.array(np.diff(ends) > 0))


def _sent(counts, most: int, holders, width: int):
    """The signatures of all sets, ``by_row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(counts.value, np.int64)
        kept, n = [], 0
        for sets in _holding(batches, holders, width):
            for s in sets:
                if len(s):
                    kept.append(signatures(s, order[bucket(s)], most))
                    n += len(kept[-1])
                    if n >= SENT:
                        yield by_row(np.concatenate(kept))
                        kept, n = [], 0
        if n:
            yield by_row(np.concatenate(kept))

    return run


def _shared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a row of the filter, the ``k`` signatures sent more than once: all that several sets have, few others."""
    sent = np.sort(np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) for batch in batches for c in batch.column("sigs")]))
    again = np.unique(sent[1:][sent[1:] == sent[:-1]])
    yield pa.RecordBatch.from_pydict({"row": pa.array([key[0].as_py()], pa.int64()), "k": pa.array([len(again)], pa.int64()), "sigs": pa.array([again.tobytes()], pa.binary())})


def _shared_bits(width: int):
    """Rows of the filter of ``2 ** width`` bits, of what ``_shared`` found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sigs in zip(batch.column(0), batch.column(1)):
                on = np.zeros(1 << (width - FILTER_ROWS), np.uint8)
                on[np.frombuffer(sigs.as_buffer(), np.uint32) >> np.uint32(SENT_BITS + FILTER_ROWS - width)] = 1
                yield pa.RecordBatch.from_pydict({"row": pa.array([row.as_py()], pa.int64()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    return run


def _signed(counts, most: int, shared, width: int, holders, holder_width: int):
    """Rows (sig, hi) of the signatures of all sets that pass the filter ``shared`` of ``2 ** width`` bits."""
    schema = pa.schema([("sig", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(counts.value, np.int64)
        passing = np.frombuffer(shared.value, np.uint8)
        for sets in _holding(batches, holders, holder_width):
            sigs, marks = [], []
            for s in sets:
                if len(s):
                    found = signatures(s, order[bucket(s)], most)
                    found = found[passes(passing, found, width)]
                    if len(found):
                        sigs.append(found.view(np.int64))
                        marks.append(fingerprint(s)[0])
            if sigs:
                yield _batch([np.concatenate(sigs), np.repeat(np.array(marks, np.int64), [len(x) for x in sigs])], schema)

    return run


_SETS = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("shingles", pa.binary())])


def held_sig(hi, holder):
    """What the filter of wanted sets knows a set and the document that holds it by (as Columns; ``_sets`` has it in
    numpy)."""
    return hi.bitwiseXOR(F.shiftleft(F.coalesce(holder, F.lit(0)), 64 - FILTER_BITS))


def _sets(wanted, width: int):
    """Rows (doc_id, hi, lo, shingles) of the documents that pass the filter of ``held_sig``: all wanted ones, few others.
    The sets of the rest, which are larger than the texts, don't leave their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            holders = batch.column(0).fill_null(0).to_numpy().view(np.uint64) << np.uint64(64 - FILTER_BITS)
            sets = []
            for d, holder, s in zip(batch.column(0).to_pylist(), holders, batch_sets(batch.column(1))):
                if len(s):
                    hi, lo = fingerprint(s)
                    if passes(bits, np.array([hi], np.int64).view(np.uint64) ^ holder, width)[0]:
                        sets.append((d, hi, lo, s.tobytes()))
            for at in range(0, len(sets), 256):
                yield _batch(list(zip(*sets[at : at + 256])), _SETS)

    return run


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity at least NUM / DEN, exactly."""
    if NUM * max(len(x), len(y)) > DEN * min(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return DEN * common >= NUM * (len(both) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))) if linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))]
        yield _batch([[a[i] for i in keep], [b[i] for i in keep]], schema)


def _scan(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks (node, comp, shingles), one for each left set and component of the right block."""
    read = lambda t: (t.column("node").to_pylist(), t.column("comp").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")])
    (a, a_comp, xs), (b, b_comp, ys) = read(left), read(right)
    out = []
    if a and b:
        size = np.array([len(y) for y in ys])
        every = np.concatenate(ys)
        order = np.argsort(every, kind="stable")
        owner, every = np.repeat(np.arange(len(ys)), size)[order], every[order]
        for node, comp, x in zip(a, a_comp, xs):
            lo, hi = np.searchsorted(every, x, "left"), np.searchsorted(every, x, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
            common = np.bincount(owner[at], minlength=len(ys))
            near = {b_comp[i]: b[i] for i in np.flatnonzero(DEN * common >= NUM * (len(x) + size - common)).tolist() if b_comp[i] != comp}
            out += [(node, other) for other in near.values()]
    return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})


def _near(x: str, y: str):
    return F.lit(NUM) * F.greatest(x, y) <= F.lit(DEN) * F.least(x, y)


def _share(df: DataFrame, r: int, rounds: int, *keys: str) -> DataFrame:
    """The rows of ``df`` of round ``r``."""
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == r) if rounds > 1 else df


class _Join:
    """The steps over nodes (distinct sets) and their lists.

    ``postings``: sig, node, n, long (its list is); ``pairs``: a, b, k, the pairs of the other lists that share enough
    signatures to link, with their number."""

    def __init__(self, postings: DataFrame, pairs: DataFrame, sets: DataFrame) -> None:
        self.long, self.pairs, self.sets = postings.filter("long").drop("long"), pairs, sets
        self.labels: DataFrame | None = None
        self.families: DataFrame | None = None

    def link(self, pairs: DataFrame) -> None:
        """Verifies ``pairs`` (a, b) and joins their components."""
        pairs = stage_table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        n = pairs.staged_rows
        if not n:
            return
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        # the set of a travels with its pair; only sets in some pair are shuffled
        wanted = stage_table(pairs.select("b").distinct(), "wanted")
        right = right.join(small_side(wanted, wanted.staged_rows, 64), "b", "left_semi")
        firsts = None
        if n * 96 > common.BROADCAST_BYTES:
            firsts = stage_table(pairs.select("a").distinct(), "firsts")
            left = left.join(small_side(firsts, firsts.staged_rows, 64), "a", "left_semi")
        found, rounds = [], self.rounds(n)
        for r in range(rounds):
            some = _share(pairs, r, rounds, "a", "b")
            both = left.join(small_side(some, n // rounds, 96), "a").join(right, "b").select("a", "b", "x", "y")
            found.append(stage_table(both.mapInArrow(_verify, "a long, b long"), "links"))
        drop_stage(pairs, wanted, firsts)
        self.labels = self._extended(found)

    def rounds(self, rows: int) -> int:
        """Rounds in which so many sets are shuffled, so that disk follows the sets and not their pairs."""
        return max(1, math.ceil(rows / (TRAVEL * max(1, self.sets.staged_rows))))

    def _extended(self, found: list[DataFrame]) -> DataFrame | None:
        """The labels joined by the links found; what they replace is dropped."""
        labels = self.labels
        some = [f for f in found if f.staged_rows]
        if some:
            labels = extend(self.labels, functools.reduce(DataFrame.unionByName, some))
            drop_stage(self.labels)
        drop_stage(*found)
        return labels

    def label(self, rows: DataFrame, node: str, comp: str) -> DataFrame:
        """Adds the component of a node, itself where it has no link yet."""
        if self.labels is None:
            return rows.withColumn(comp, F.col(node))
        return rows.join(self.labels.select(F.col("node").alias(node), F.col("comp").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))

    def first_members(self) -> None:
        """Each set against the one it shares most signatures with; in long lists, of the lists' heads: their sets in
        most long lists, which the others are edited from. Sets that share long lists make up a family."""
        degree = self.long.groupBy("node").agg(F.count("*").alias("d"), F.first("n").alias("n"))
        told = self.long.drop("n").join(degree, "node")
        heads = stage_table(told.groupBy("sig").agg(F.max_by("node", F.struct("d", "node")).alias("b")), "heads")
        # a row for each long list: broadcast where that is small, else a join whose hot lists adaptive execution splits
        met = stage_table(self.long.join(small_side(heads, heads.staged_rows, 48), "sig").groupBy("node", "b").agg(F.count("*").alias("k")), "met")
        drop_stage(heads)
        if met.staged_rows:
            family = components(met.select(F.col("node").alias("a"), "b"))
            self.families = stage_table(degree.join(family.withColumnRenamed("comp", "family"), "node"), "families")
            drop_stage(family)
        met = met.filter("b != node")
        either = self.pairs.select(F.col("a").alias("node"), "b", "k").unionByName(self.pairs.select(F.col("b").alias("node"), F.col("a").alias("b"), "k")).unionByName(met)
        best = either.groupBy("node").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        self.link(best.select(F.col("node").alias("a"), "b"))

    def divided(self) -> DataFrame | None:
        """``node, d, family, comp, main`` of the families that have several components; main: in the largest."""
        if self.families is None:
            return None
        rows = self.label(self.families, "node", "comp")
        sized = rows.groupBy("family", "comp").agg(F.count("*").alias("k"))
        most = sized.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("c"), F.count("*").alias("comps")).filter("comps > 1")
        most = stage_table(most, "mains")
        out = stage_table(rows.join(small_side(most, most.staged_rows, 48), "family").select("node", "d", "n", "family", "comp", (F.col("comp") == F.col("c")).alias("main")), "divided")
        drop_stage(most)
        return out if out.staged_rows else None

    def outsiders(self) -> None:
        """Sets outside their family's largest component against TRIES of its sets in most long lists."""
        rows = self.divided()
        if rows is None:
            return
        ranked = Window.partitionBy("family").orderBy(F.desc("d"), "node")
        central = rows.filter("main").withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= TRIES)
        central = stage_table(central.select("family", F.col("node").alias("b")), "central")
        self.link(rows.filter("not main").select(F.col("node").alias("a"), "family").join(small_side(central, central.staged_rows, 48), "family").select("a", "b"))
        drop_stage(central, rows)

    def rest(self) -> None:
        """All pairs of different components: those listed, then those within families."""
        self.link(self.label(self.label(self.pairs, "a", "ca"), "b", "cb").filter("ca != cb").select("a", "b"))
        self.scan_families()

    def units(self, rows: DataFrame) -> DataFrame:
        """``unit, node, comp, main, size`` of what is scanned whole, for the ``rows`` of divided families.

        A link that is left shares a long list. Either a family is one unit, or each of its lists that holds several
        components is, lists of the same sets once: whichever has fewer pairs. ``size`` is a class of set sizes; linked
        sets are at most one class apart."""
        kept = ["node", "family", "comp", "main", "n"]
        held = stage_table(self.long.select("sig", "node").join(small_side(rows.select(*kept), rows.staged_rows, 64), "node"), "held")
        outer, inner = F.count_if(~F.col("main")).alias("x"), F.count_if("main").alias("m")
        marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"h{k}") for k in (0, 1)]
        told = held.groupBy("family", "sig").agg(outer, inner, *marks, (F.min("comp") < F.max("comp")).alias("mixed")).filter("mixed")
        once = stage_table(told.groupBy("family", "x", "m", "h0", "h1").agg(F.min("sig").alias("sig")), "once")
        pairs = F.col("x") * (F.col("x") / 2 + F.col("m"))
        by_lists = once.groupBy("family").agg(F.sum(pairs).alias("listed"))
        whole = rows.groupBy("family").agg(outer, inner).select("family", pairs.alias("whole"))
        cheaper = stage_table(whole.join(by_lists, "family").filter("listed < whole").select("family"), "cheaper")
        n = cheaper.staged_rows
        lists = stage_table(once.join(small_side(cheaper, n, 24), "family", "left_semi").select("sig"), "scanned")
        families = rows.join(small_side(cheaper, n, 24), "family", "left_anti").select(F.concat(F.lit("f"), F.col("family").cast("string")).alias("unit"), *kept)
        listed = held.join(small_side(lists, lists.staged_rows, 24), "sig").select(F.concat(F.lit("l"), F.col("sig").cast("string")).alias("unit"), *kept)
        # a little wider than the ratio, so that rounding parts no linked sets by two
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(DEN / NUM) * (1 + 1e-9))).cast("int")
        out = stage_table(families.unionByName(listed).select("unit", "node", "comp", "main", size.alias("size")), "units")
        drop_stage(held, once, cheaper, lists)
        return out

    def scan_families(self) -> None:
        """In each unit, blocks of sets outside their family's largest component (x) against blocks of all others of
        near sizes (x or m), scanned whole: a set's shingles are looked up in an inverted list of the block, the counts
        give exact similarities, and a link to each component is returned once. Blocks travel, pairs don't."""
        rows = self.divided()
        if rows is None:
            return
        units = self.units(rows)
        blocks = lambda test: F.ceil(F.count_if(test) / F.lit(BLOCK)).cast("int")
        sized = stage_table(units.groupBy("unit", "size").agg(blocks(~F.col("main")).alias("nx"), blocks(F.col("main")).alias("nm")), "sized")
        n = sized.staged_rows
        own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("nm")).otherwise(F.col("nx"))).cast("int")
        dealt = units.join(small_side(sized, n, 64), ["unit", "size"]).select("unit", "size", "node", "comp", "main", own.alias("i"))
        near = dealt.withColumn("other", F.explode(F.array(*(F.col("size") + k for k in (-1, 0, 1)))))
        near = near.join(small_side(sized.withColumnRenamed("size", "other"), n, 64), ["unit", "other"])
        x, m = near.filter("not main"), near.filter("main")
        mine, theirs, i, j = (F.col(c) for c in ("size", "other", "i", "j"))
        same, above = theirs == mine, theirs > mine
        upto = lambda n: F.when(n >= 0, F.sequence(F.lit(0), n))
        block = lambda tag, c, k: F.concat_ws(".", F.lit(tag), c.cast("string"), k.cast("string"))

        def copies(rows: DataFrame, others, left, right) -> DataFrame:
            """A copy of each row for each of the ``others``, blocks j that it meets."""
            return rows.withColumn("j", F.explode(others)).select("node", "comp", F.concat_ws(":", "unit", left, right).alias("key"))

        last_x, last_m = F.col("nx") - 1, F.col("nm") - 1
        with_m = copies(x, upto(last_m), block("x", mine, i), block("m", theirs, j))
        with_x = copies(x, F.when(same, F.sequence(i, last_x)).when(above, upto(last_x)), block("x", mine, i), block("x", theirs, j))
        of_m = copies(m, upto(last_x), block("x", theirs, j), block("m", mine, i))
        of_x = copies(x, F.when(same, upto(i)).when(~above, upto(last_x)), block("x", theirs, j), block("x", mine, i))
        left, right = (stage_table(a.unionByName(b), "blocks") for a, b in ((with_m, with_x), (of_m, of_x)))
        # columns named anew on either side: the cogroup must tell them apart
        fresh = lambda d: d.select(*(F.col(c).alias(c) for c in d.columns))
        found, rounds = [], self.rounds(left.staged_rows + right.staged_rows)
        for r in range(rounds):
            some = ((_share(d, r, rounds, "key"), d.staged_rows // rounds) for d in (left, right))
            x, y = (fresh(fresh(self.sets).join(small_side(d, n, 128), "node").select("key", "node", "comp", "shingles")) for d, n in some)
            found.append(stage_table(x.groupBy("key").cogroup(y.groupBy("key")).applyInArrow(_scan, "a long, b long"), "links"))
        self.labels = self._extended(found)
        drop_stage(rows, units, sized, left, right)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: its set's size, and the least doc_id reachable by links.

    Null and empty texts, and texts without words, have size 0 and are their own component. Repeated rows are one node.
    A null doc_id stays null and is no component's id unless the component has no other (then null). An empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    bound_batches(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = stage_table(named.mapInArrow(_documents, "doc_id long, n long, hi long, lo long, chunk int, counts binary"), "documents")
    members = scanned.filter("n is not null").select("doc_id", "n", "hi", "lo")
    # A fixed number of counts, whatever the input, and the documents by set size up to MOST_SMALL.
    summed = scanned.filter("chunk is not null").groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in summed:
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    sizes = {r["n"]: r["k"] for r in members.filter(F.col("n").between(1, 2 * MOST_SMALL)).groupBy("n").agg(F.count("*").alias("k")).collect()}
    total = max(1.0, float(counts.sum()))
    spread = float(np.square(counts, dtype=np.float64).sum()) - total - total * total / len(counts)
    most = boundary(sizes, max(0.0, spread / total))
    held = spark.sparkContext.broadcast(counts.tobytes())  # 8 MB, whatever the input
    del summed, counts

    nodes = members.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    nodes = stage_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n_nodes = nodes.staged_rows
    # Of equal sets one document's signatures are taken: what is sent twice is in several sets. Only bits of them are
    # shuffled, as the filter needs no more.
    holder_width = filter_width(n_nodes, HOLDER_BITS)
    holding = _filter(nodes.select("doc_id").mapInArrow(_marked, "sig long"), holder_width)
    sent = named.mapInArrow(_sent(held, most, holding, holder_width), "row long, sigs binary")
    lists, seen = stage_counted(sent.groupBy("row").applyInArrow(_shared, "row long, k long, sigs binary"), "lists", F.sum("k").alias("shared"))
    width = filter_width(seen["shared"] or 0)
    passing = _gathered(lists.select("row", "sigs").mapInArrow(_shared_bits(width), "row long, bits binary"), width)
    drop_stage(lists)
    # by the set alone, so that one shuffle serves the rows' distinctness and the join; a second set of the same hi would
    # only add candidates
    passed = named.mapInArrow(_signed(held, most, passing, width, holding, holder_width), "sig long, hi long").repartition("hi").distinct()
    postings = stage_table(passed.join(small_side(nodes.select("hi", "node", "n"), n_nodes, 96), "hi").select("sig", "node", "n"), "postings")
    sized = postings.groupBy("sig").agg(F.count("*").alias("k"))
    in_lists = stage_table(postings.join(sized.filter("k > 1"), "sig").select("sig", "node", "n", (F.col("k") > LONG).alias("long")), "in_lists")
    drop_stage(postings)
    others = in_lists.filter("not long").drop("long")
    far = in_lists.filter("long").select("node").distinct().withColumn("far", F.lit(True))
    again = others.select("sig", F.col("node").alias("b"), F.col("n").alias("m"))
    asked = F.least(*(F.when(F.col(c) <= most, 1).otherwise(1 + F.floor(F.col(c) / MORE)) for c in ("n", "m")))
    met = others.withColumnRenamed("node", "a").join(again, "sig").filter((F.col("a") < F.col("b")) & _near("n", "m")).groupBy("a", "b").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    # a pair whose sets are both in long lists may share more there
    both = met.join(far.select(F.col("node").alias("a"), F.col("far").alias("fa")), "a", "left").join(far.select(F.col("node").alias("b"), F.col("far").alias("fb")), "b", "left")
    pairs = stage_table(both.filter((F.col("k") >= asked) | (F.col("fa") & F.col("fb"))).select("a", "b", "k"), "near")

    # The sets of nodes that may link, each from the document with its least id: no set is shuffled for it.
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(in_lists.filter("long").select("node")).distinct()
    wanted = stage_table(wanted.join(nodes.select("hi", "lo", "node", F.col("doc_id").alias("holder")), "node"), "wanted")
    n_wanted = wanted.staged_rows
    held.destroy()
    passing.destroy()
    holding.destroy()
    labels = None
    if n_wanted:
        width = filter_width(n_wanted)
        holders = _filter(wanted.select(held_sig(F.col("hi"), F.col("holder")).alias("sig")), width)
        held_by = F.col("doc_id").eqNullSafe(F.col("holder"))
        sets = named.mapInArrow(_sets(holders, width), "doc_id long, hi long, lo long, shingles binary").join(small_side(wanted, n_wanted, 128), ["hi", "lo"]).filter(held_by).select("node", "shingles")
        sets = stage_table(sets, "sets")
        if sets.staged_rows > n_wanted:  # rows repeated whole
            sets = stage_table(sets.dropDuplicates(["node"]), "sets")
        holders.destroy()
        join = _Join(in_lists, pairs, sets)
        join.first_members()
        join.outsiders()
        join.rest()
        labels = join.labels
        drop_stage(sets, join.families)
    placed = nodes.withColumn("comp", F.col("node"))
    if labels is not None:
        placed = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stage_table(placed.select("hi", "lo", "doc_id", "comp"), "placed")
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    known = stage_table(placed.join(least, "comp").select("hi", "lo", "component_id"), "known")
    drop_stage(nodes, in_lists, pairs, wanted, placed, labels)
    out = members.join(small_side(known, n_nodes, 96), ["hi", "lo"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their component, all columns kept; a repeated row stays once.

    Rows without words link with nothing and all stay, as do rows without an id, which can't be named."""
    found = stage_table(ngram_join(docs, id_col, text_col), "found")
    kept = found.filter("n_shingles > 0 and doc_id = component_id")
    counted, seen = stage_counted(kept.groupBy("doc_id").agg(F.count("*").alias("k")), "kept", F.count_if(F.col("k") > 1).alias("repeated"))
    single, repeated = counted.filter("k = 1").select(F.col("doc_id").alias("_one")), counted.filter("k > 1").select(F.col("doc_id").alias("_one"))
    bare = stage_table(found.filter("n_shingles = 0").select(F.col("doc_id").alias("_one")).distinct(), "bare")
    ones = single.join(bare, "_one", "left_anti").unionByName(bare)
    n = counted.staged_rows + bare.staged_rows
    # mostly fewer are dropped than stay; texts are shuffled only where neither fits the bound
    gone = stage_table(found.filter("doc_id is not null").select(F.col("doc_id").alias("_one")).distinct().join(ones, "_one", "left_anti"), "gone")
    n_gone = gone.staged_rows
    if n_gone < n:
        out = docs.join(small_side(gone, n_gone, 24), docs[id_col] == F.col("_one"), "left_anti")
    else:
        out = docs.join(small_side(ones, n, 24), docs[id_col] == F.col("_one"), "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    if seen["repeated"]:
        again = docs.join(small_side(repeated, n, 24), docs[id_col] == F.col("_one"), "left_semi")
        out = out.unionByName(again.dropDuplicates([id_col]))
    return out
