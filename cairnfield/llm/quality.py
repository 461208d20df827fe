"""Quality rules: base counts of every text, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Tokens are runs of word characters and runs of ASCII punctuation, A-Z lower-cased; tokens and pairs of neighbours fall
into ``BUCKETS`` buckets by a hash. All rows count for the raw multinomial, trusted ones for the target, and a bucket's
weight is the logarithm of the two smoothed shares' quotient in whole millionths, so sums don't depend on their order. A
document's score is the mean weight of its n-grams.

The threshold is a fixed rule: ``MARGIN`` below zero, or ``SPREAD`` standard deviations below the mean score of trusted
documents where that is less. One in five trusted documents, by a hash of the id, is left out of the target counts and
gives that mean, so it is measured on documents the target has not seen.

Defined results: null and empty texts have no words and fail the base rules; without trusted documents all weights are
0 and the base rules decide alone; repeated rows count and are judged each; rows without an id are never trusted; an
empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, small_side, stage_table, unit_draw

BUCKETS = 1 << 16
#: What the first token of a pair is multiplied with.
PAIR = 40503
#: Unit of weights and scores: a millionth of a nat.
UNIT = 1_000_000
MARGIN, SPREAD = 100_000, 6.0
#: Hashes of tokens a worker keeps before it begins anew.
KEPT_HASHES = 1 << 18
#: The share of trusted documents that is left out of the target counts, and the seed of its draw.
LEFT_OUT, SEED = 0.2, "quality"
#: Base rules: fewest words, and most repeated words of a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[!-/:-@\[-^`{-~]+")
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Bytes that begin a character in a word.
BEGINS = np.array([not (b == 32 or 9 <= b <= 13 or 128 <= b < 192) for b in range(256)])
SYMBOL = np.array([b in b"#*$%&|<>" for b in range(256)])


class Hashes(dict):
    """Token -> the first 32 bits of its md5, made when first asked for."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KEPT_HASHES:
            self.clear()
        self[token] = h = int.from_bytes(hashlib.md5(token).digest()[:4], "big")
        return h


def ngram_buckets(text: bytes, hashes: Hashes) -> np.ndarray:
    """The bucket of each token and of each pair of neighbours."""
    h = np.array([hashes[t] for t in TOKEN.findall(text.translate(LOWER))], np.int64)
    return np.concatenate([h, h[:-1] * PAIR + h[1:]]) % BUCKETS


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pairs = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1].astype(np.int64)
    _, which, counts = np.unique(pairs * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again, covered = counts[which] > 1, np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words, bytes_of = text.split(), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(bytes_of[BEGINS].sum()), int(bytes_of[SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target, hashes = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), Hashes()
    for batch in batches:
        for text, trusted in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
            n = np.bincount(ngram_buckets(text, hashes), minlength=BUCKETS)
            raw += n
            if trusted:
                target += n
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], schema=_COUNTS)


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed shares in whole units; all 0 without a target."""
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    share = lambda x: np.log((x + 1) / (x.sum() + BUCKETS))
    return np.rint(UNIT * (share(target) - share(raw))).astype(np.int64)


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "weight")


def _measure(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                grams = ngram_buckets(text, hashes)
                rows.append((*base_counts(text), len(grams), int(table[grams].sum())))
            told = zip(*rows) if rows else [[]] * len(_STATS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in told)], names=["doc_id", *_STATS])

    return run


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``_trusted``: the ids all of whose labels are 1."""
    told = labels.filter(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_trusted"))
    return told.agg(F.min(quality_col).alias("_q")).filter("_q = 1").select("_trusted")


def left_out(id_col: str) -> Column:
    return unit_draw(id_col, seed=SEED) < LEFT_OUT


def _with_trust(rows: DataFrame, trusted: DataFrame, n: int) -> DataFrame:
    side = small_side(trusted, n, 32)
    return rows.join(side, rows["doc_id"] == side["_trusted"], "left")


def ngram_weights(docs: DataFrame, trusted: DataFrame, n_trusted: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The weight of every bucket: a fixed-size count over all rows, summed within tasks and then across them."""
    bound_batches(docs.sparkSession)
    rows = _with_trust(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), trusted, n_trusted)
    seen = rows.select("text", (F.col("_trusted").isNotNull() & ~left_out("doc_id")).alias("trusted"))
    counted = seen.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counted.collect():  # at most BUCKETS rows, whatever the input
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return weights(raw, target)


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: bool = True) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score`` of every row;
    ``trusted`` is a table of distinct ids in ``_trusted``. The score is in millionths of a nat per n-gram."""
    trusted = stage_table(trusted, "trusted")
    n_trusted = trusted.count()
    table = ngram_weights(docs, trusted, n_trusted, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = stage_table(rows.mapInArrow(_measure(table), ", ".join(f"{n} long" for n in ("doc_id", *_STATS))), "measured")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    mean = F.when(F.col("n_grams") > 0, F.floor(F.col("weight") / F.col("n_grams"))).otherwise(0)
    scored = measured.withColumns({"base_failed": failed, "score": mean})
    cut = threshold(_with_trust(scored.filter(~F.col("base_failed") & left_out("doc_id")), trusted, n_trusted).filter("_trusted is not null")) if table.any() else None
    verdict = ~F.col("base_failed") & (F.col("score") >= cut if cut is not None else F.lit(True))
    return scored.select("doc_id", *_STATS[:5], "base_failed", verdict.alias("kept"), "score")


def threshold(scores: DataFrame) -> float:
    """The least score that is kept, from the ``score`` column of documents known to be good; one row to the driver."""
    r = scores.agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.sum((F.col("score") * F.col("score")).cast("decimal(20,0)")).alias("q")).first()
    if not r["n"]:
        return float(-MARGIN)
    mean, square = r["s"] / r["n"], float(r["q"]) / r["n"]
    return min(float(-MARGIN), mean - SPREAD * max(0.0, square - mean * mean) ** 0.5)


def keep_good(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` all of whose judgements are to keep, all columns kept."""
    bad = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]+') AS tokens FROM d
), p AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), t AS (
  SELECT rid, pos, word, lead(word) OVER (PARTITION BY rid ORDER BY pos) AS word2, lead(word, 2) OVER (PARTITION BY rid ORDER BY pos) AS word3 FROM p
), r AS (
  SELECT rid, pos, word3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, word2, word3) > 1 AS again FROM t
), c AS (
  SELECT rid, again OR coalesce(lag(again) OVER (PARTITION BY rid ORDER BY pos), false) OR coalesce(lag(again, 2) OVER (PARTITION BY rid ORDER BY pos), false) AS covered FROM r
), rep AS (SELECT rid, count(*) FILTER (WHERE covered) AS n FROM c GROUP BY rid
), l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), b AS (
  SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
), k AS (SELECT rid, doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM w
), h AS (SELECT rid, doc_id, pos, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM k
), g2 AS (SELECT rid, doc_id, h, lead(h) OVER (PARTITION BY rid ORDER BY pos) AS h2 FROM h
), g AS (
  SELECT rid, doc_id, h % 65536 AS bucket FROM g2 UNION ALL SELECT rid, doc_id, (h * 40503 + h2) % 65536 FROM g2 WHERE h2 IS NOT NULL
), tr AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), fold AS (SELECT doc_id, CAST('0x' || substr(md5('quality:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.2 AS held FROM tr
), n AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM fold WHERE NOT held)) AS target FROM g GROUP BY bucket
), s AS (SELECT sum(raw) AS r, sum(target) AS t FROM n
), wt AS (
  SELECT bucket, CASE WHEN t = 0 THEN 0 ELSE CAST(round(1000000 * (ln((target + 1) / (t + 65536)) - ln((raw + 1) / (r + 65536)))) AS BIGINT) END AS weight FROM n, s
), sc AS (SELECT rid, CAST(floor(CAST(sum(weight) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM g JOIN wt USING (bucket) GROUP BY rid
), o AS (SELECT f.*, coalesce(sc.score, 0) AS score FROM f LEFT JOIN sc USING (rid)
), m AS (
  SELECT count(*) AS n, CAST(sum(score) AS DOUBLE) / count(*) AS mean, CAST(sum(score * score) AS DOUBLE) / count(*) AS sq
  FROM o WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM fold WHERE held)
), cut AS (SELECT CASE WHEN n = 0 THEN -100000.0 ELSE least(-100000.0, mean - 6.0 * sqrt(greatest(0.0, sq - mean * mean))) END AS least FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ((SELECT t FROM s) IS NULL OR (SELECT t FROM s) = 0 OR score >= (SELECT least FROM cut)) AS kept, CAST(score AS BIGINT) AS score
FROM o
"""
