"""Cross-tokenizer alignment by diagonal run skipping.

A text's tokens under two vocabularies become two rising arrays of byte ends. Where both end, a group ends. From a common
start at indices (i, j) the arrays are compared at the shift j - i: exponential probing doubles the compared stretch
while it agrees, then halves it, so a one-to-one run is jumped over whole. Where they disagree, the lesser end is moved
on until both agree again: the tokens passed form an irregular group, each step links the two current tokens, and the
shift is updated.

``aligned`` writes, for each text, its groups and how often each id pair is linked. Corpus-wide counts are summed within
tasks, then by pair. They go back to the texts in two steps without a hot key: the most frequent pairs, of a bounded
number, are broadcast; every other pair is so rare that a join by pair has no large key.

Defined results: null and empty texts, and those whose tokens' bytes under either vocabulary are not the space and text,
have no tokens and count nothing; repeated rows count and are told each; a null id stays null; an empty table gives no
rows. Columns other than id and text are not read. Special tokens' strings are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage, stage_table
from .tokens import byte_letters, encoder, vocabulary_path

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is one number, the first above the second's bits.
B_BITS = 32
#: Pairs that are broadcast at most: 40 bytes each, 20 MB.
HEAD_PAIRS = 1 << 19
#: Tokens compared in the first probe of a run.
FIRST_PROBE = 8
#: Characters of a text given to the piece encoder at once, where it can be cut.
STRETCH = 1 << 16


def skip_runs(a: list[int], b: list[int]) -> tuple[array, array, array]:
    """(one-to-one runs, each as its first indices and length; ends of irregular groups; links in these, each as two
    indices) of two rising lists with the same last value, flat. An end is the number of tokens up to it."""
    runs, ends, links = array("q"), array("q"), array("q")
    i, j, n, link = 0, 0, len(a), links.append
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            run, step = 1, FIRST_PROBE
            while (part := a[i + run : i + run + step]) and part == b[j + run : j + run + step]:
                run += len(part)
                step *= 2
            while step > 1:
                step //= 2
                if (part := a[i + run : i + run + step]) and part == b[j + run : j + run + step]:
                    run += len(part)
            runs.extend((i, j, run))
            i += run
            j += run
            continue
        link(i)
        link(j)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            link(i)
            link(j)
        i += 1
        j += 1
        ends.extend((i, j))
    return runs, ends, links


def align(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group ends in a, in b, links' indices into a, into b) of two rising lists with the same last value; ends in
    order, links in no order."""
    runs, ends, links = skip_runs(a, b)
    (i, j, n), (end_a, end_b), (link_a, link_b) = (np.array(x, np.int64).reshape(-1, k).T for x, k in ((runs, 3), (ends, 2), (links, 2)))
    run_a = np.arange(n.sum()) + np.repeat(i - np.cumsum(n) + n, n)
    run_b = run_a + np.repeat(j - i, n)
    return np.sort(np.concatenate([run_a + 1, end_a])), np.sort(np.concatenate([run_b + 1, end_b])), np.concatenate([run_a, link_a]), np.concatenate([run_b, link_b])


class ByteTokens:
    """Ids of space and text by a byte-level vocabulary file, and each id's bytes."""

    def __init__(self, path: str) -> None:
        self.encode_text = encoder(path).encode
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        entries = told["model"]["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max(entries.values()))
        for piece, i in entries.items():
            self.bytes_of[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_text(" " + text)


class PieceTokens:
    """Ids of a text by a piece model, which puts a space before it, and each id's bytes.

    If no piece of the model holds a space after another character, no piece reaches over the place before a space: a
    long text is encoded in stretches that end there, the model putting back the space each next one begins with."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.can_cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.cut = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")

    def encode(self, text: str) -> np.ndarray:
        ids, at = [], 0
        while self.can_cut and len(text) - at > STRETCH:
            m = self.cut.search(text, at + STRETCH)
            if not m:
                break
            ids += self.model.encode(text[at : m.start()], num_threads=1)
            at = m.end()
        return np.array(ids + self.model.encode(text[at:] if at else text, num_threads=1), np.int64)


@dataclass
class Side:
    """One tokenizer as a worker holds it."""

    encode: Callable[[str], np.ndarray]
    bytes_of: list[bytes]
    lengths: np.ndarray
    names: list[str]  # of both sides: of each id in the middle of a group, then of each at the end of its side of it


@functools.cache
def _tokens(a_path: str, b_path: str) -> tuple[Side, Side]:
    """The worker's two tokenizers, loaded once."""
    both = ByteTokens(a_path), PieceTokens(b_path)
    names = [f"{i}{after}" for t, end in zip(both, "|;") for after in (",", end) for i in range(len(t.bytes_of))]
    return tuple(Side(t.encode, t.bytes_of, np.array([len(x) for x in t.bytes_of], np.int64), names) for t in both)


def token_ends(text: str, side: Side) -> tuple[np.ndarray, list[int]] | None:
    """(ids, byte ends) of space and text; None if the ids' bytes are not these."""
    ids = side.encode(text).astype(np.int64)
    if b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != b" " + text.encode():
        return None
    return ids, np.cumsum(side.lengths[ids]).tolist()


def group_text(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, sides: tuple[Side, Side]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group. Every id's place among all is its own index and the number of the
    other side's tokens before it."""
    ends = [np.zeros(len(ids), bool) for ids in (a, b)]
    for e, cuts in zip(ends, (cuts_a, cuts_b)):
        e[cuts - 1] = True
    group = [np.cumsum(e) - e for e in ends]
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.concatenate([[0], cuts_b])[group[0]]] = a + ends[0] * len(sides[0].bytes_of)
    out[np.arange(len(b)) + cuts_a[group[1]]] = 2 * len(sides[0].bytes_of) + b + ends[1] * len(sides[1].bytes_of)
    return "".join(map(sides[0].names.__getitem__, out.tolist()))[:-1]


def linked_pairs(a: np.ndarray, b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id pairs as numbers, how many links hold each)."""
    pair = np.sort((a[links_a] << B_BITS) | b[links_b])
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pair[first], np.diff(np.append(first, len(pair)))


def align_text(text: str | None, sides: tuple[Side, Side]) -> tuple | None:
    """(ids a, ids b, group ends in a, in b, links in a, in b) of a text; None where it has no tokens."""
    if not text:
        return None
    a, b = (token_ends(text, side) for side in sides)
    return (a[0], b[0], *align(a[1], b[1])) if a and b else None


_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64())]))
_ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", _PAIRS)])
_ALIGNED_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, k: long>>"


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, row = _tokens(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            told, pairs, counts, sizes = [], [], [], []
            for text in batch.column(1):
                found = align_text(text.as_py(), sides)
                if found is None:
                    told.append((0, 0, 0, 0, ""))
                    sizes.append(0)
                    continue
                a, b, cuts_a, cuts_b, links_a, links_b = found
                digest = hashlib.sha256(group_text(a, b, cuts_a, cuts_b, sides).encode()).hexdigest()
                told.append((len(a), len(b), len(cuts_a), len(links_a), digest))
                pair, k = linked_pairs(a, b, links_a, links_b)
                pairs.append(pair)
                counts.append(k)
                sizes.append(len(pair))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (pairs, counts)], names=["pair", "k"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
            columns = [pa.array(c, t) for c, t in zip(zip(*told), [pa.int64()] * 4 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *columns, listed], schema=_ALIGNED)
            row += batch.num_rows

    return run


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The written table of alignments: ``row`` (a number of its own), ``doc_id``, sizes, the digest of the groups, and
    ``pairs``: each id pair (a << 32 | b) and how many of the text's links hold it."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(_align(a_path or vocabulary_path(A_NAME), b_path or vocabulary_path(B_NAME)), _ALIGNED_DDL), "aligned")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, group, start, end, a_ids, b_ids``: each group of each text, by byte offsets in space and text."""
    bound_batches(docs.sparkSession)
    a_path, b_path = a_path or vocabulary_path(A_NAME), b_path or vocabulary_path(B_NAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _tokens(a_path, b_path)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = align_text(text.as_py(), sides)
                if found is None:
                    continue
                a, b, cuts_a, cuts_b = found[:4]
                ends = np.cumsum(sides[0].lengths[a])[cuts_a - 1]
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, cuts), pa.int32()), pa.array(ids, pa.int32())) for cuts, ids in ((cuts_a, a), (cuts_b, b))]
                n = len(cuts_a)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.concatenate([[0], ends[:-1]])), pa.array(ends), *lists], names=["doc_id", "group", "start", "end", "a_ids", "b_ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, group long, start long, end long, a_ids array<int>, b_ids array<int>")


def pair_counts(alignments: DataFrame) -> DataFrame:
    """``pair, n, best``: each id pair's links in all texts, and whether no pair of its b id has more. A row a pair; the
    rows of ``best`` by b id are as many as the second vocabulary's entries."""
    each = alignments.select(F.explode("pairs").alias("_p")).select("_p.pair", "_p.k")
    counts = stage_table(each.groupBy("pair").agg(F.sum("k").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_most"))
    told = counts.join(F.broadcast(most), b_id == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))
    return told


def split_counts(counts: DataFrame, most: int = HEAD_PAIRS) -> tuple[DataFrame, DataFrame | None]:
    """(pairs to broadcast, the others or None if there are none): those with the greatest counts, at most ``most``,
    by powers of two. Each of the others holds less than one in ``most`` of all links, or fewer than two."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["pairs"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}  # at most 64 rows
    if sum(sizes.values()) <= most:
        return counts, None
    least, held = 63, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > most:
            break
        least, held = k, held + sizes[k]
    return counts.filter(level >= least), counts.filter(level < least)


def link_sums(alignments: DataFrame, counts: DataFrame, most: int = HEAD_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of every text that has links."""
    each = alignments.select("row", F.explode("pairs").alias("_p")).select("row", F.col("_p.pair").alias("_pair"), F.col("_p.k").alias("k"))
    head, tail = split_counts(counts, most)
    summed = lambda df: df.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    met = summed(each.join(F.broadcast(head), each["_pair"] == head["pair"]))
    if tail is None:
        return met
    rest = each.join(F.broadcast(head.select("pair")), each["_pair"] == F.col("pair"), "left_anti")
    rare = summed(rest.join(tail.hint("shuffle_merge"), rest["_pair"] == tail["pair"]))
    return met.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, most: int = HEAD_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    table = aligned(docs, id_col, text_col, a_path, b_path)
    counts = stage_table(pair_counts(table), "counts")
    sums = stage_table(link_sums(table, counts, most).withColumnRenamed("row", "_row"), "sums")
    drop_stage(counts)
    told = table.drop("pairs").join(sums, F.col("row") == F.col("_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
