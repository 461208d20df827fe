"""Manifests: scans driven by them, incremental skips, upserts, counts, duplicates by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import table_of
from .windows import running_sums, with_least


def exact_duplicates(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """``key, sha256, status, detail, kept``: the first of each content by key is ok, later ones are skipped.

    Contents are read once; only keys and digests are shuffled, and those of a common content are not gathered."""
    marked = table_of(rows.select(F.col(key), F.sha2(content, 256).alias("sha256")), "digests")
    later = F.col(key) != F.col("kept")
    return with_least(marked, "sha256", key, "kept").select(key, "sha256", F.when(later, "skipped").otherwise("ok").alias("status"), F.when(later, "duplicate_sha256").alias("detail"), "kept")


def scan_ready(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct paths, in order, of ok PDF rows whose file exists (``files``: ``path``)."""
    ready = manifest.filter((F.col("status") == "ok") & (F.col("content_type") == "application/pdf") & (F.length("relative_path") > 0) & F.lower("relative_path").endswith(".pdf"))
    return ready.join(files.withColumnRenamed("path", "relative_path"), "relative_path", "left_semi").select("relative_path").distinct().orderBy("relative_path")


def embed_candidates(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Rows chunked or skipped, with a path whose file exists."""
    some = manifest.filter(F.col("status").isin("ok", "skipped") & F.col("chunks_jsonl_relative_path").isNotNull() & (F.length("chunks_jsonl_relative_path") > 0))
    return some.join(files.withColumnRenamed("path", "chunks_jsonl_relative_path"), "chunks_jsonl_relative_path", "left_semi")


def unchanged(recorded: Column, now: Column) -> Column:
    """Times of modification alike to a microsecond; null or not a number means changed."""
    return F.coalesce(F.abs(recorded.try_cast("double") - now) < 1e-6, F.lit(False))


def to_embed(chunks: DataFrame, embedded: DataFrame, key: str, mtime: str) -> DataFrame:
    """Chunk rows without an embedded row of the same key and modification time."""
    done = embedded.filter(F.col("status").isin("embedded", "skipped_empty")).select(F.col(key).alias("_k"), F.col("chunks_mtime_unix").alias("_m"))
    return chunks.join(done, (F.col(key) == F.col("_k")) & unchanged(F.col("_m"), F.col(mtime)), "left_anti")


def stale(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without an output at least as new (both: key, ``mtime``)."""
    made = outputs.groupBy(key).agg(F.max("mtime").alias("_m"))
    return inputs.join(made, key, "left").filter(F.col("_m").isNull() | (F.col("_m") < F.col("mtime"))).select(*inputs.columns)


def upsert(existing: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's whole row: the last update by ``order`` if there is one, else the last existing row."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(updates.withColumn("_p", F.lit(1)))
    rest = [c for c in existing.columns if c not in (key, order)]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_p", order)).alias("_r"))
    return best.select(key, *(F.col("_r")[c].alias(c) for c in rest))


def replace_by_key(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The target with all rows of the batch's keys replaced by the batch; repeating it changes nothing."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def status_counts(rows: DataFrame, status: str, domain: tuple[str, ...]) -> DataFrame:
    """``status, n`` for each status of the domain, zero where none."""
    table = rows.sparkSession.createDataFrame([(s,) for s in domain], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return table.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def run_counters(rows: DataFrame, order: str, status: str, domain: tuple[str, ...]) -> DataFrame:
    """Adds ``n_<status>``: rows of each status up to and with this one, in order, over the whole run."""
    one = {f"n_{s}": F.when(F.col(status) == s, 1).otherwise(0) for s in domain}
    return running_sums(rows, [], order, one).withColumns({n: F.col(n) + c for n, c in one.items()})


def viewer_stats(rows: DataFrame, stem: str = "source_stem") -> DataFrame:
    """One row: documents, ok, skipped and error rows, and the chunks of ok rows whose count is a number."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    chunks = F.sum(F.when(F.col("status") == "ok", F.col("chunk_count").try_cast("long")))
    return rows.agg(F.count_distinct(stem).alias("n_docs"), n("ok"), n("skipped"), n("error"), F.coalesce(chunks, F.lit(0)).alias("n_chunks"))


def first_rows(rows: DataFrame, n: int | None, *order: str, from_end: bool = False) -> DataFrame:
    """The first n rows in order; None keeps all, a negative n none, or with ``from_end`` all but the last -n, counted."""
    ordered = rows.orderBy(*order)
    if n is None:
        return ordered
    return ordered.limit(max(0, rows.count() + n if n < 0 and from_end else n))


def seed_if_empty(existing: DataFrame, seeds: DataFrame) -> DataFrame:
    """The table, or the seed rows where it has none."""
    return seeds if existing.limit(1).isEmpty() else existing
