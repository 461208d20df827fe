"""Change-driven rules and incremental tables as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.incremental import replace_by_key
from ..operators.rules import critical_result, vital_alerts

_BATCH, _BUCKET = "upsert_batch", "upsert_bucket"
_PLACE = StructType().add(_BATCH, "integer").add(_BUCKET, "integer")


def alert_stream(patches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Vital alerts of a stream of patches, appended exactly once; all that is there is processed, then it stops."""
    return vital_alerts(patches).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: Buckets of an upserted table: a batch rewrites only those its keys fall into.
BUCKETS = 64


def read_upserted(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The table as it is (as it was before a batch): of each bucket the last version."""
    rows = spark.read.schema(StructType([*schema.fields, *_PLACE.fields])).parquet(path)
    rows = rows if before is None else rows.filter(F.col(_BATCH) < before)
    last = rows.groupBy(_BUCKET).agg(F.max(_BATCH).alias(_BATCH))  # a row for each bucket
    return rows.join(last, [_BUCKET, _BATCH], "left_semi").select(*schema.fieldNames())


def upsert_stream(batches: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its keys' rows in a table below ``path``, of which it writes new versions of the
    buckets it touches (``upsert_batch=<n>/upsert_bucket=<b>``). Repeating a batch writes the same versions, so a retry changes nothing."""

    def replace(batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
        rows = batch
        if touched and number:
            rows = replace_by_key(read_upserted(spark, path, batch.schema, number).filter(bucket.isin(touched)), batch, key)
        rows.withColumn(_BUCKET, bucket).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/{_BATCH}={number}")
        batch.unpersist()

    return batches.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def critical_stream(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alerts of exams that become critical, from a stream of updates (``id, patient_id, at, name, status, result``).

    The state of an exam is its last status; the updates of a micro-batch are taken in the order of ``at``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        before = [state.get[0] if state.exists else None, *rows["status"].tolist()[:-1]]
        state.update((rows["status"].iloc[-1],))
        became = [s == "critical" != b for s, b in zip(rows["status"], before)]
        yield rows[became]

    edges = updates.groupBy("id").applyInPandasWithState(run, updates.schema, "status string", "append", GroupStateTimeout.NoTimeout)
    told = edges.select("id", "patient_id", "at", *(c.alias(n) for n, c in critical_result(F.col("name"), F.col("result")).items()))
    return told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Alerts by category and event-time window, with a watermark for late rows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def read_patches(spark: SparkSession, folder: str, schema: str, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(folder)
