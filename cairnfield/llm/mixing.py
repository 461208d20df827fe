"""Mixing sources to target weights: tokens per source, repetition rates, then copies.

Each document is taken ``floor(rate)`` times plus one more with a probability equal to the rate's fraction: a draw
from a hash of the seed, the source, the id, the size and the ordinal among rows alike in these, so reruns agree and
repeated rows draw apart. The seed is chosen for each source, out of ``SEEDS`` fixed ones, as the one whose sum comes
nearest the target; every draw stays a Bernoulli one and the share of extra copies still follows the fraction. No
document is taken more than ``max_epochs`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, gapless, small_side, stage_table, unit_draw

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Fixed seeds, ``mix-0`` and on, of which each source takes the best.
SEEDS = 64
#: Sources a task ranks.
RANK_ROWS = 100_000
#: Repeated rows a bucket of their numbering should hold.
BUCKET_ROWS = 50_000


def n_words(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame, size: Column, source_col: str = "source") -> DataFrame:
    """``source, source_size, n``, aggregated before the shuffle; null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("long").alias("source_size"), F.count("*").alias("n"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 by code point, null last; ranges of sources are ranked apart and their counts summed up."""
    parts = max(1, sources.count() // RANK_ROWS)
    order = [F.col("source").asc_nulls_last()]
    ranges = stage_table(sources.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("_part").agg(F.count("*").alias("_k")).select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranges.withColumn("_inner", inner).join(starts, "_part").select(*sources.columns, (F.col("_start") + F.col("_inner")).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` and ``rate``. The sources share the sum of all sizes by weight; a target stops at ``max_epochs``
    times its source's size and the excess is shared again by weight, until none is above. A source without words has
    target and rate 0.

    Each round is one aggregation that returns three numbers; what a unit of weight gets only rises, so it ends."""
    cycle = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stage_table(ranked(sources).withColumn("_w", cycle.cast("long")), "sources")
    cap = F.col("source_size") * F.lit(max_epochs)
    share, capped = -1.0, -1
    while True:
        full = F.lit(share) * F.col("_w") > cap if share >= 0 else F.lit(False)
        s = weighed.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w"))), F.count(F.when(full, 1))).first()
        if s[3] == capped or not s[2]:
            break
        capped, share = s[3], ((s[0] or 0) - (s[1] or 0)) / s[2]
    target = F.when(F.lit(share) * F.col("_w") > cap, cap.cast("double")).otherwise(F.lit(max(share, 0.0)) * F.col("_w"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return weighed.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(seed: Column, source: Column, key: Column, size: Column, ordinal: Column) -> Column:
    return unit_draw(seed, source, key, size, ordinal, seed="mix")


def copies(rate: Column, drawn: Column) -> Column:
    """``floor(rate)`` plus a Bernoulli draw of the rate's fraction."""
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def numbered(docs: DataFrame, group: list[str], out: str) -> DataFrame:
    """``docs`` with ``out``: 0, or the place among rows alike in ``group``. Rows alike in all columns are counted
    before any shuffle; the others of a group are numbered in buckets, so no group is ever one task."""
    repeats = stage_table(docs.groupBy(*group).agg(F.count("*").alias("_n")).filter("_n > 1").select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(group)), "_n"), "repeats")
    k, rows = repeats.agg(F.count("*"), F.sum("_n")).first()
    if not k:
        drop_stage(repeats)
        return docs.withColumn(out, F.lit(0).cast("long"))
    side = small_side(repeats.drop("_n"), k, 128)
    same = [docs[c].eqNullSafe(side[f"_r{i}"]) for i, c in enumerate(group)]
    whole = stage_table(docs.join(side, same, "left_semi").groupBy(*docs.columns).agg(F.count("*").alias("_n")), "alike")
    placed = gapless(whole.withColumn("_h", F.xxhash64(*docs.columns)), group, ["_h"], "_n", "_first", max(1, rows // BUCKET_ROWS))
    each = placed.withColumn(out, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))).select(*docs.columns, out)
    return docs.join(side, same, "left_anti").withColumn(out, F.lit(0).cast("long")).unionByName(each)


def seeds(rows: DataFrame, goal: DataFrame, n_goal: int, n_seeds: int = SEEDS) -> DataFrame:
    """``source, source_size, target, rate, seed`` of each source: the seed whose words come nearest the target, in one
    aggregation. ``rows``: ``doc_id, source, size, ordinal``."""
    side = small_side(goal.select(F.col("source").alias("_s"), (F.col("rate") - F.floor("rate")).alias("_f")).filter("_f > 0"), n_goal, 256)
    told = rows.filter("size > 0").join(side, rows["source"].eqNullSafe(side["_s"])).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))))
    hit = draw(F.col("seed"), F.col("source"), F.col("doc_id"), F.col("size"), F.col("ordinal")) < F.col("_f")
    sums = told.groupBy("source", "seed").agg(F.sum(F.when(hit, F.col("size")).otherwise(0)).alias("extra"))
    sums = sums.select(F.col("source").alias("_s"), "seed", "extra")
    off = F.abs(F.floor("rate") * F.col("source_size") + F.coalesce("extra", F.lit(0)) - F.col("target"))
    tried = goal.join(sums, goal["source"].eqNullSafe(sums["_s"]), "left").withColumn("off", off)
    best = tried.groupBy("source", "source_size", "target", "rate").agg(F.min_by("seed", F.struct("off", "seed")).alias("seed"))
    return best.withColumn("seed", F.coalesce("seed", F.lit(0)))


def _drawn(docs: DataFrame, rows: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """``docs`` with ``_mix_size, _mix_target`` of its source and ``_mix_copies``. ``rows``: ``doc_id, source, size,
    ordinal`` of all; ``names``: what these are called in ``docs``."""
    goal = stage_table(targets(source_sizes(rows, F.col("size"))), "targets")
    n = goal.staged_rows
    chosen = stage_table(seeds(rows, goal, n), "seeds")
    drop_stage(goal)
    side = small_side(chosen.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"), F.col("target").alias("_mix_target"), F.col("rate").alias("_mix_rate"), F.col("seed").alias("_mix_seed")), n, 256)
    doc_id, source, size, ordinal = (F.col(c) for c in names)
    joined = docs.join(side, docs[names[1]].eqNullSafe(side["_mix_source"]))
    return joined.withColumn("_mix_copies", copies(F.col("_mix_rate"), draw(F.col("_mix_seed"), source, doc_id, size, ordinal)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    Null text: size 0. Null source: a source of its own. A null id draws as the text ``null``; repeated rows draw apart.
    Other columns are not read. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = stage_table(rows, "sizes")
    rows = numbered(sized, ["source", "doc_id", "size"], "ordinal")
    out = _drawn(rows, rows, ("doc_id", "source", "size", "ordinal"))
    taken = F.col("size") * F.col("_mix_copies")
    return out.select("doc_id", "size", F.col("_mix_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all its columns kept and none added.

    Of rows alike in source, id and size but not in all columns, which ones get the copies follows a hash of the row."""
    sized = docs.withColumn("_mix_n", n_words(F.col(text_col)))
    each = numbered(sized, [source_col, id_col, "_mix_n"], "_mix_i")
    rows = stage_table(sized.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col("_mix_n").alias("size")), "sizes")
    out = _drawn(each, numbered(rows, ["source", "doc_id", "size"], "ordinal"), (id_col, source_col, "_mix_n", "_mix_i"))
    return out.filter("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM s
), o AS (
  SELECT *, 3 * source_size / w AS r,
         CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER before AS BIGINT), 0) AS rest,
         CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER before AS BIGINT), 0) AS rest_w
  FROM w WINDOW before AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(CAST(rest AS DOUBLE) / rest_w, r) FILTER (WHERE CAST(rest AS DOUBLE) / rest_w <= r) AS share FROM o
), t AS (
  SELECT source, source_size, CASE WHEN share * w > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE share * w END AS target
  FROM o, l
), g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
), n AS (
  SELECT d.*, g.source_size, g.target, floor(rate) AS fl, rate - floor(rate) AS f,
         'mix:' || seed || ':' || coalesce(d.source, 'null') || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size || ':' AS key,
         row_number() OVER (PARTITION BY d.source, doc_id, size, seed) - 1 AS ordinal, seed
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, range(0, 64) AS x(seed)
), u AS (
  SELECT *, CAST(fl + CASE WHEN CAST(('0x' || substr(md5(key || ordinal), 1, 13)) AS BIGINT) / 4503599627370496.0 < f THEN 1 ELSE 0 END AS BIGINT) AS copies FROM n
), b AS (
  SELECT source, arg_min(seed, (off, seed)) AS seed FROM (
    SELECT source, seed, abs(sum(size * copies) - any_value(target)) AS off FROM u GROUP BY source, seed
  ) GROUP BY source
)
SELECT u.doc_id, u.size, u.source_size, u.target, u.size * u.copies AS taken
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.seed = b.seed
"""
