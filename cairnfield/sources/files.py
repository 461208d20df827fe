"""File sources and sinks: manifests, pages, chunks, archives, exam results."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines manifest; blank lines are skipped, a malformed line fails, a missing file is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``stem, page, markdown`` from ``*.pages.jsonl``, or from what ``write_pages`` wrote; by page within a stem. A
    missing markdown is empty."""
    rows = spark.read.schema(schemas.PAGES).option("mode", "FAILFAST").json(path)
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.pages\.jsonl$", 1)
    stem = F.when(named != "", named).otherwise(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/stem=([^/]*)/", 1)))
    return rows.select(stem.alias("stem"), "page", F.coalesce("markdown", F.lit("")).alias("markdown")).sortWithinPartitions("stem", "page")


def write_pages(pages: DataFrame, path: str) -> None:
    """``stem, page, markdown`` as JSON lines in a folder for each stem; a run replaces the folder."""
    pages.select("stem", "page", "markdown").write.mode("overwrite").partitionBy("stem").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """``text, metadata`` as JSON lines, which ``read_chunks`` reads; nulls are left out, a run replaces the folder."""
    chunks.select("text", "metadata").write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with their ids; a chunk without a stem fails."""
    from ..operators.chunking import chunk_id

    rows = spark.read.schema(schemas.CHUNKS).option("mode", "FAILFAST").json(path)
    return rows.select(chunk_id(F.col("metadata.source_stem"), F.col("metadata.chunk_index")).alias("id"), "text", "metadata")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``path, name, mtime, bytes`` of the files below a folder, without their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def zip_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``archive, relative_path, bytes, sha256``: a row for each archive (path null) and each of its members."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"]):
                rows.append((name, None, len(content), hashlib.sha256(content).hexdigest()))
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            data = z.read(m)
                            rows.append((name, m.filename, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["archive", "relative_path", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, "archive string, relative_path string, bytes long, sha256 string")


def read_exam_results(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated exam results: masked years are null, dates parsed, reference ranges ``a a b`` as two numbers."""
    rows = spark.read.schema(schemas.EXAM_RESULTS).option("sep", "|").option("header", "true").csv(path)
    bound = lambda i: F.regexp_replace(F.regexp_extract("DE_VALOR_REFERENCIA", r"([0-9.,]+)\s+a\s+([0-9.,]+)", i), ",", ".").try_cast("double")
    return rows.withColumns({"birth_year": F.col("AA_NASCIMENTO").try_cast("int"), "collected_on": F.try_to_date("DT_COLETA", "dd/MM/yyyy"), "reference_low": bound(1), "reference_high": bound(2)})


def write_manifest(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, UTF-8 as it is; overwrites unless appending."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "true").json(path)


def run_summary(rows: DataFrame, script_version: str, listing_url: str, started_at: str, updated_at: str) -> DataFrame:
    """The one-row summary of a download run: counts by status and the first 20 errors by id, then ``...`` if there are
    more. Only so many errors are gathered."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    first = rows.filter("status = 'error'").select("id", F.coalesce("detail", F.lit("")).alias("detail")).orderBy("id", "detail").limit(21)
    told = first.agg(F.sort_array(F.collect_list(F.struct("id", "detail")))["detail"].alias("_e"))
    shown = F.when(F.size("_e") > 20, F.array_append(F.slice("_e", 1, 20), F.lit("..."))).otherwise(F.col("_e"))
    counted = rows.agg(count("ok"), count("skipped"), count("error"), F.count("*").alias("links_discovered")).join(told).withColumn("errors", shown)  # one row each
    return counted.select(F.lit(started_at).alias("run_started_at"), F.lit(updated_at).alias("last_updated_at"), F.lit(script_version).alias("script_version"), F.lit(listing_url).alias("listing_url"), "links_discovered", F.struct("ok", "skipped", "error").alias("counts"), "errors")
