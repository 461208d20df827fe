"""Tables as append-only logs of changes, and their state at any time.

A change is a whole row put, or a key deleted, at a time; ``SEQ`` orders changes of one time. The state at a time is each
key's last change up to it, combined before the shuffle, so a key with very many changes does not gather. The state at
many times, one for each asking row, is an as-of lookup over ranges of the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hashed_id
from . import admissions
from .windows import WIDTH, as_of

AT, SEQ, OP = "_at", "_seq", "_op"
PUT, DELETE = "put", "delete"


def puts(rows: DataFrame, at: Column, seq: Column | int = 0) -> DataFrame:
    """``rows`` as changes that put them."""
    return rows.withColumns({AT: at, SEQ: (seq if isinstance(seq, Column) else F.lit(seq)).cast("long"), OP: F.lit(PUT)})


def deletes(rows: DataFrame, key: str, at: Column, seq: Column | int = 0) -> DataFrame:
    """Changes that delete the keys of ``rows``; the other columns are null."""
    gone = rows.select(*(F.col(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return puts(gone, at, seq).withColumn(OP, F.lit(DELETE))


def append(changes: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of changes to the log at ``path``. A batch written again replaces itself and nothing else, so a run
    that is repeated after a failure appends once."""
    changes.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """All changes of the log at ``path``."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def state_at(changes: DataFrame, key: str, at: Column | None = None) -> DataFrame:
    """The table as it was at ``at`` (changes of that very time count), or as it is."""
    upto = changes if at is None else changes.filter(F.col(AT) <= at)
    rest = [c for c in changes.columns if c not in (key, AT, SEQ, OP)]
    last = upto.groupBy(key).agg(F.max_by(F.struct(OP, *rest), F.struct(AT, SEQ)).alias("_r"))
    return last.filter(F.col("_r")[OP] == PUT).select(key, *(F.col("_r")[c].alias(c) for c in rest))


def state_for(asks: DataFrame, changes: DataFrame, key: str, at: Column, out: str, width: int = WIDTH) -> DataFrame:
    """``asks`` with ``out``: the row of its key as it was at its own time, a struct of the other columns; null where
    there was none or it was deleted."""
    rest = [c for c in changes.columns if c not in (key, AT, SEQ, OP)]
    told = as_of(asks, changes, key, at, F.col(AT), [SEQ, OP, *rest], "_change", width)
    row = F.struct(*(F.col("_change")[c].alias(c) for c in rest))
    return told.withColumn(out, F.when(F.col("_change")[OP] == PUT, row)).drop("_change")


def readmission(tables: dict[str, DataFrame], requests: DataFrame, protocols: DataFrame, default: dict, at: Column, when: str, order: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(changes of each table, refused patients) that readmitting the requested patients makes.

    ``tables``: ``patients, exams, items, log, vitals``. The patient is admitted at the time, exams and items are deleted
    and those of the protocol put, the last vitals (by ``order``) are carried into a new row, and the log tells it."""
    asked = admissions.readmissible(tables["patients"], requests)
    fine = asked.filter(~F.col("refused")).drop("refused")
    exams, items, log = admissions.protocol_children(fine, protocols, default, "readmission", when)
    vitals = admissions.readmitted_vitals(fine, tables["vitals"], order, F.lit(when))
    ours = fine.select(F.col("id").alias("patient_id"))
    named = lambda df, kind: df.withColumn("id", hashed_id(kind, F.lit("readmission"), F.lit(when), F.col("patient_id")))
    changes = {"patients": [puts(fine.withColumns({"status": F.lit("admitted"), "admitted_at": F.lit(when)}), at, 1)]}
    for name, fresh in (("exams", exams), ("items", items)):
        old = tables[name].join(ours, "patient_id", "left_semi").select(*tables[name].columns)
        changes[name] = [deletes(old, "id", at), puts(fresh, at, 1)]
    changes["log"], changes["vitals"] = [puts(named(log, "al"), at, 1)], [puts(named(vitals, "vs"), at, 1)]
    told = {}
    for name, parts in changes.items():
        columns = [*tables[name].columns, AT, SEQ, OP]
        told[name] = reduce(DataFrame.unionByName, (_shaped(p, tables[name], columns) for p in parts))
    return told, asked.filter("refused")


def _shaped(changes: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The changes with a table's columns and types, null where they have none."""
    kinds = dict(table.dtypes)
    return changes.select(*((F.col(c) if c in changes.columns else F.lit(None)).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in columns))
