"""Patients as a whole: the nested record, and the changes of state that derive children anew.

A change takes tables and returns tables; deleted children go by anti joins, derived ones come from the code's protocol.
Ids are hashes of what a row is derived from, so repeating a change gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashed_id
from .catalogs import apply_protocols
from .records import DEFAULT_VITALS, nested, replace_children, with_children
from .windows import latest

CAMEL = {"patient_id": "patientId", "created_at": "createdAt", "recorded_at": "updatedAt", "requested_at": "requestedAt", "admitted_at": "admittedAt", "protocol_ref": "protocolRef", "blood_pressure": "bloodPressure", "oxygen_saturation": "oxygenSaturation", "heart_rate": "heartRate", "current_medications": "currentMedications"}


def camel(df: DataFrame) -> DataFrame:
    """Columns named as responses have them."""
    return df.withColumnsRenamed({a: b for a, b in CAMEL.items() if a in df.columns})


def full_record(patients: DataFrame, exams: DataFrame, attachments: DataFrame, items: DataFrame, log: DataFrame, vitals: DataFrame) -> DataFrame:
    """``id, body``: each patient's record as camelCase JSON, nulls kept, in one plan.

    Exams (latest first, each with its attachments), items (by id), log (latest first) and the latest vitals, or the
    default ones. Children are gathered a patient each, since a response holds them all. ``log`` and ``exams`` need
    ``at_us``, their time as a whole number; it is not shown."""
    files = nested(attachments.withColumnRenamed("exam_id", "_e"), "_e", "attachments", F.col("id"))
    shown = F.transform("attachments", lambda a: F.struct(a["name"], a["mime"], a["size"], a["path"]))
    told = with_children(exams.withColumn("_e", F.col("id")), "_e", files).drop("_e").withColumn("attachments", shown)
    told = nested(camel(told), "patientId", "exams", -F.col("at_us"), F.col("id"))
    told = told.withColumn("exams", F.transform("exams", lambda e: e.dropFields("at_us")))
    steps = nested(camel(log), "patientId", "agentLog", -F.col("at_us"), -F.col("id"))
    steps = steps.withColumn("agentLog", F.transform("agentLog", lambda e: e.dropFields("at_us")))
    given = camel(latest(vitals, "patient_id", "at_us", "id").drop("at_us", "id"))
    fields = [c for c in given.columns if c != "patientId"]
    default = F.struct(*(F.lit(DEFAULT_VITALS[k]).alias(CAMEL.get(k, k)) for k in DEFAULT_VITALS if CAMEL.get(k, k) in fields), F.lit(None).cast("string").alias("updatedAt"))
    rows = with_children(patients.withColumnRenamed("id", "patientId"), "patientId", told, nested(camel(items), "patientId", "suggestedItems", F.col("id")), steps)
    rows = rows.join(given.select("patientId", F.struct(*fields).alias("_v")), "patientId", "left").withColumn("vitalSigns", F.coalesce("_v", default.cast(given.select(F.struct(*fields).alias("v")).schema["v"].dataType)))
    body = F.struct(F.col("patientId").alias("id"), *(F.col(c) for c in camel(patients).columns if c not in ("id", "cid_code", "cid_label")), F.struct(F.col("cid_code").alias("code"), F.col("cid_label").alias("label")).alias("cid"), "vitalSigns", "exams", "suggestedItems", "agentLog")
    return rows.select(F.col("patientId").alias("id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def protocol_children(patients: DataFrame, protocols: DataFrame, default: dict, step: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exams, items, log) that the patients' codes ask for. ``patients``: ``id, cid_code``."""
    told = apply_protocols(patients.select("id", "cid_code"), "cid_code", protocols, default)
    exams = told.select(F.col("id").alias("patient_id"), "protocol_ref", F.posexplode("exams").alias("i", "name"))
    exams = exams.select(hashed_id("ex", F.lit(step), F.col("patient_id"), F.col("i")).alias("id"), "patient_id", "name", F.lit(at).alias("requested_at"), F.lit("pending").alias("status"), F.lit("protocol").alias("source"), "protocol_ref")
    items = told.select(F.col("id").alias("patient_id"), "protocol_ref", F.posexplode("actions").alias("i", "a"))
    items = items.select(hashed_id("sa", F.lit(step), F.col("patient_id"), F.col("i")).alias("id"), "patient_id", "a.type", "a.description", F.lit("suggested").alias("status"), "protocol_ref")
    log = told.select(F.col("id").alias("patient_id"), F.lit(step).alias("step"), F.lit("done").alias("status"), F.concat(F.lit("Protocolo aplicado para CID "), "cid_code").alias("detail"), F.lit(at).alias("timestamp"))
    return exams, items, log


def code_changes(patients: DataFrame, changes: DataFrame) -> DataFrame:
    """Patients of ``changes`` (``id, cid_code, cid_label``) whose code differs, with the new code."""
    new = changes.select(F.col("id").alias("_i"), F.col("cid_code").alias("_c"), F.col("cid_label").alias("_l"))
    met = patients.join(new, patients["id"] == F.col("_i")).filter("_c != cid_code")
    return met.withColumns({"cid_code": F.col("_c"), "cid_label": F.col("_l")}).select(*patients.columns)


def changed(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of the same key replaced."""
    return replace_children(table, rows, key, rows)


def readmissible(patients: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested patients with ``refused``: those admitted already can't be readmitted."""
    return patients.join(requests.select("id").distinct(), "id", "left_semi").withColumn("refused", F.coalesce(F.col("status") == "admitted", F.lit(False)))


def readmitted_vitals(readmitted: DataFrame, vitals: DataFrame, order: list[str], at: Column) -> DataFrame:
    """A row of vitals for each readmitted patient: the last ones carried forward, or the default ones."""
    fields = [c for c in vitals.columns if c in DEFAULT_VITALS]
    last = latest(vitals, "patient_id", *order).select("patient_id", *fields)
    joined = readmitted.select(F.col("id").alias("patient_id")).join(last, "patient_id", "left")
    return joined.select("patient_id", *(F.coalesce(c, F.lit(DEFAULT_VITALS[c])).alias(c) for c in fields), at.alias("recorded_at"))


def cascade(patients: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table when ``patients`` are deleted: children by ``patient_id``; attachments with their exams."""
    gone = patients.select(F.col("id").alias("patient_id"))
    left = {n: t.join(gone, "patient_id", "left_anti") for n, t in tables.items() if n != "attachments"}
    if "attachments" in tables:
        exams = tables["exams"].join(gone, "patient_id", "left_semi").select(F.col("id").alias("exam_id"))
        left["attachments"] = tables["attachments"].join(exams, "exam_id", "left_anti")
    return left


def accept_all(items: DataFrame, patients: DataFrame) -> DataFrame:
    """Suggested items of the given patients become accepted; other states stay."""
    marked = items.join(patients.select(F.col("id").alias("patient_id"), F.lit(True).alias("_m")).distinct(), "patient_id", "left")
    return marked.withColumn("status", F.when(F.col("_m") & (F.col("status") == "suggested"), "accepted").otherwise(F.col("status"))).select(*items.columns)


def upload_target(exams: DataFrame, requests: DataFrame) -> DataFrame:
    """Upload requests (``exam_id, ...``) with ``refused``: only exams entered by hand take files."""
    side = exams.select(F.col("id").alias("exam_id"), F.col("source").alias("_s"))
    return requests.join(side, "exam_id").withColumn("refused", ~F.col("_s").eqNullSafe(F.lit("manual"))).drop("_s")
