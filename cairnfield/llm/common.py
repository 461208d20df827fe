"""Helpers the operators share: shared-folder tables, size-checked broadcasts, gapless numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import bound_batches, shared_dir, write_table  # noqa: F401

#: A side is broadcast only when it was counted and has at most so many bytes.
BROADCAST_BYTES = 32 << 20


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``staged_rows`` of the result is its number of rows, observed as they are written: each job less is that much less
    that the driver keeps. An operator drops the tables its result does not read. The result is lazy and reads the others: they belong to the
    caller, who drops them by ``drop_stages`` once the result is written."""
    return stage_counted(df, name, **options)[0]


def stage_counted(df: DataFrame, name: str, *seen: Column, **options: str) -> tuple[DataFrame, dict[str, int]]:
    """``stage_table``, and the named aggregates ``seen`` of the rows written."""
    path, told = stage_path(df.sparkSession, name), Observation()
    write_table(df.observe(told, F.count(F.lit(1)).alias("_rows"), *seen), path, **options)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path, back.staged_rows = path, told.get["_rows"]
    return back, told.get


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_stage(*tables: DataFrame | None) -> None:
    """Remove what ``stage_table`` wrote, once nothing lazy reads it any more."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            _delete(df.sparkSession, path)


def drop_stages(spark: SparkSession) -> None:
    """Remove all stage tables of this application; results that still read them can't be computed afterwards."""
    _delete(spark, _stages(spark))


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when its counted size is within the bound, else as it is (shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def unit_draw(*parts: Column | str, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the parts' text: 52 bits, the same on every engine and rerun.

    A null part counts as the text ``null``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def gapless(df: DataFrame, group: list[str], order: list[str], weight: str, out: str, buckets: int) -> DataFrame:
    """Adds ``out``: within each group, the sum of ``weight`` over the rows before this one.

    No group is ever one task: rows are dealt to ``buckets`` buckets by a hash of ``order``; a window numbers each
    bucket, and the buckets' totals (one small row each) are summed up and joined back."""
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sums = dealt.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    on = [placed[k].eqNullSafe(starts[k]) for k in keys]
    return placed.join(starts, on).select(*(placed[c] for c in df.columns), (F.col("_start") + F.col("_inner")).alias(out))
