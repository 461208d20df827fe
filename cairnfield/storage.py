"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Where it is unset, a new local one for a local master (tests); any
    other master fails, as its executors would write to disks of their own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairnfield-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bounds of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Statements run within remove their shuffle files when they end. Otherwise these stay until the driver happens to
    collect garbage: a job of many written tables holds all their shuffles on disk at once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


def write_table(df: DataFrame, path: str, **options: str) -> None:
    """``df`` as a table; what its shuffles left on disk goes at once."""
    with shuffles_dropped(df.sparkSession):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def table_of(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back: a cut of lineage that later plans read by the
    columns they need. It stays until the application's folder is cleared, as what is read from it is lazy."""
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, so that very long texts fit a worker's memory."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).removesuffix("B").removesuffix("b") or 0) <= most:
            spark.conf.set(name, str(most))
