"""Streams by event time: alerts on changes of status in the order of the updates' times, and windows and sessions that
count late rows up to the watermark and repeated ones once.

A micro-batch is where updates happen to be cut, so nothing here depends on it: updates wait in state until the watermark
has passed them, and are then taken in their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, TimestampType

from ..operators.rules import critical_result

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedEdges(StatefulProcessor):
    """Rows whose status became ``to``, taken by (``at_us``, ``seq``) once the watermark has passed them.

    State of a key: the status and time of the last row taken, the rows that wait. A timer stands at the first that waits.
    With ``forget_ms``, a status counts for that long; where no row waits, a timer then lets the key go.

    Each use of the state is a call to the JVM, and a list state gives out its rows one by one: the rows that wait are one
    value, an array a column, and the timer is known from the state."""

    def __init__(self, fields: StructType, to: str, forget_ms: int | None) -> None:
        self.fields, self.to, self.forget_ms = fields, to, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([*(f for f in self.fields if f.name == "status"), StructField("at_us", LongType())]))
        self.waiting = handle.getValueState("waiting_columns", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.fields]))

    def _held(self) -> list[tuple]:
        held = self.waiting.get()
        return list(zip(*held)) if held is not None else []

    def _timer(self, rows: list[tuple], when: int | None) -> int | None:
        """Where the key's timer stands while ``rows`` wait and the last one taken is of ``when``."""
        if rows:
            at = self.fields.names.index("at_us")
            return min(r[at] for r in rows) // 1000
        return when // 1000 + self.forget_ms if self.forget_ms is not None and when is not None else None

    def _release(self, held: list[tuple], new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        names = self.fields.names
        at, seq, status = (names.index(n) for n in ("at_us", "seq", "status"))
        rows = held + new
        ready = sorted((r for r in rows if r[at] // 1000 <= watermark_ms), key=lambda r: (r[at], r[seq]))
        later = [r for r in rows if r[at] // 1000 > watermark_ms]
        before, when = self.last.get() or (None, None)
        stood = self._timer(held, when)
        told = []
        for r in ready:
            if when is not None and self.forget_ms is not None and r[at] // 1000 >= when // 1000 + self.forget_ms:
                before = None  # as the timer would have it, had it fired in between
            if r[status] == self.to != before:
                told.append(r)
            before, when = r[status], r[at]
        if ready:
            self.last.update((before, when))
        if later:
            self.waiting.update(tuple(map(list, zip(*later))))
        elif held:
            self.waiting.clear()
        stands = self._timer(later, when)
        if stood is not None and stood != stands:
            self.handle.deleteTimer(stood)
        if stands is not None and stood != stands:
            self.handle.registerTimer(stands)
        if told:
            yield pd.DataFrame(told, columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        column = lambda c: c.astype(object).where(c.notna(), None).tolist() if c.hasnans else c.tolist()
        new = [r for part in rows for r in zip(*(column(part[n]) for n in self.fields.names))]
        yield from self._release(self._held(), new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if held := self._held():
            yield from self._release(held, [], timerValues.getCurrentWatermarkInMs())
        else:
            self.last.clear()

    def close(self) -> None:
        pass


@contextmanager
def _state_provider(spark: SparkSession):
    """RocksDB as state store for queries started within, as timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def ordered_critical_stream(updates: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", forget_ms: int | None = None) -> StreamingQuery:
    """Alerts of exams that become critical, from a stream of updates (``id, patient_id, at`` (timestamp)``, seq, name,
    status, result``), by event time: any cut of the updates into batches, and any order within ``late`` of the newest,
    gives the same alerts. Updates that the watermark has passed are dropped."""
    timed = updates.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    fields = StructType([f for f in timed.schema.fields if not isinstance(f.dataType, TimestampType)])
    shown = timed.select("at", *fields.names)
    edges = shown.groupBy("id").transformWithStateInPandas(OrderedEdges(fields, "critical", forget_ms), fields, "append", "EventTime")
    told = edges.select("id", "patient_id", "at_us", "seq", *(c.alias(n) for n, c in critical_result(F.col("name"), F.col("result")).items()))
    with _state_provider(updates.sparkSession):
        return told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def once(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """A stream's rows by the first of each ``key`` within ``late``; older rows than the watermark are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark([key])


def window_stream(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", late: str = "10 minutes", window: str = "1 hour") -> StreamingQuery:
    """``start, event_type, n`` of each event-time window that the watermark has closed, repeated events counted once."""
    counts = once(events, key, "ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    told = counts.select(F.col("window.start").alias("start"), "event_type", "n")
    return told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def session_stream(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", late: str = "10 minutes", gap: str = "30 minutes") -> StreamingQuery:
    """``user_id, start, end, n`` of each user's sessions that the watermark has closed: events less than ``gap`` apart."""
    counts = once(events, key, "ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    told = counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    return told.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
