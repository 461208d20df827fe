"""Alert rules: level-triggered on what a patch holds, edge-triggered on status changes, pending exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import systolic, vital_critical
from .windows import last_given

#: Kind, field of a patch, message (with the field's text in it).
VITAL_RULES = (
    ("oxygen_saturation", "oxygen_saturation", "SpO2 crítico registrado (%s%%)."),
    ("temperature", "temperature", "Temperatura crítica registrada (%s °C)."),
    ("heart_rate", "heart_rate", "Frequência cardíaca crítica registrada (%s bpm)."),
    ("systolic", "blood_pressure", "Pressão arterial crítica registrada (%s)."),
)
#: Exams whose pending result is critical.
CRITICAL_EXAMS = ("PCR", "Hemograma", "Lactato")
MANY_PENDING = 3


def vital_alerts(patches: DataFrame) -> DataFrame:
    """An alert for each violated field that the patch holds; a stateless filter, so it also runs on a stream.

    Needs ``patient_id, recorded_at`` and the four fields, null where the patch lacks one."""
    candidates = []
    for kind, field, message in VITAL_RULES:
        value = systolic(F.col(field)) if kind == "systolic" else F.col(field)
        shown = F.format_string("%.1f", F.col(field)) if kind == "temperature" else F.col(field).cast("string")
        hit = F.coalesce(vital_critical(F.lit(kind), value), F.lit(False))
        candidates.append(F.when(hit, F.struct(F.lit(kind).alias("kind"), F.format_string(message, shown).alias("message"))))
    each = patches.select("patient_id", "recorded_at", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("a"))
    return each.select("patient_id", "recorded_at", "a.kind", F.lit("critical").alias("severity"), F.lit("clinical").alias("category"), "a.message", F.lit("doctors").alias("team"))


def transitions(rows: DataFrame, key: str, order: list[str], status: str, to: str) -> DataFrame:
    """Rows whose status became ``to``: the key's row before had another, or there was none."""
    told = last_given(rows, key, order, {"_before": F.struct(F.col(status).alias("s"))}, with_row=False)
    told = told.withColumn("previous_status", F.col("_before.s")).drop("_before")
    return told.filter((F.col(status) == to) & ~F.col("previous_status").eqNullSafe(F.lit(to)))


def critical_result(name: Column, result: Column) -> dict[str, Column]:
    """The alert of an exam that has become critical; an exam without a result says so."""
    shown = F.when(F.length(result) > 0, result).otherwise("sem valor informado")
    return {"severity": F.lit("critical"), "category": F.lit("exam"), "message": F.concat(F.lit("Resultado crítico registrado para "), name, F.lit(": "), shown, F.lit(".")), "team": F.lit("doctors")}


def critical_result_alerts(updates: DataFrame, key: str, order: list[str], status: str, name: Column, result: Column) -> DataFrame:
    """The updates that made an exam critical, with the alert's ``severity, category, message, team``."""
    return transitions(updates, key, order, status, "critical").withColumns(critical_result(name, result))


def pending_alerts(exams: DataFrame, patient: str, name: Column, status: Column, order: str) -> DataFrame:
    """``patient, severity, message``: more than three pending exams are critical, fewer moderate with their first
    three names; a pending exam of a critical kind is critical besides. Only sums and three rows a patient are kept."""
    pending = exams.filter(status == "pending").select(F.col(patient).alias("patient"), F.col(order).alias("o"), name.alias("name"))
    kind = F.lit(False)
    for k in CRITICAL_EXAMS:
        kind = kind | F.col("name").contains(k)
    ranked = Window.partitionBy("patient").orderBy("o")
    first = pending.withColumn("r", F.row_number().over(ranked)).filter("r <= 3").groupBy("patient").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o", "name")))["name"], ", ").alias("names"))
    counted = pending.groupBy("patient").agg(F.count("*").alias("n"), F.min_by(F.when(kind, F.col("name")), F.when(kind, F.col("o"))).alias("critical"))
    many = F.struct(F.lit("critical").alias("severity"), F.format_string("%d exames pendentes que requerem atenção imediata.", "n").alias("message"))
    some = F.struct(F.lit("moderate").alias("severity"), F.format_string("Exames aguardando revisão: %s.", "names").alias("message"))
    urgent = F.struct(F.lit("critical").alias("severity"), F.format_string("Exame crítico pendente: %s. Revisão urgente solicitada.", "critical").alias("message"))
    told = F.array(F.when(F.col("n") > MANY_PENDING, many).otherwise(some), F.when(F.col("critical").isNotNull(), urgent))
    each = counted.join(first, "patient").select("patient", F.explode(F.filter(told, lambda a: a.isNotNull())).alias("a"))
    return each.select("patient", "a.severity", "a.message")


def flow_lines(rows: DataFrame, base: str) -> DataFrame:
    """``id, line_no, line, sepsis_critical, pharmacy_interaction``: the decision flow's lines, a second apart.

    Needs ``id, code, name, age, protocol, interaction, exam_names`` (array) ``, n_items``."""
    at = lambda s: F.date_format(F.lit(base).cast("timestamp_ntz") + F.expr(f"interval {s} seconds"), "HH:mm:ss")
    stamp = lambda s, text: F.concat(F.lit("["), at(s), F.lit("] "), text)
    # The wording of the lines.
    exams = F.array_join(F.transform("exam_names", lambda n: F.split_part(n, F.lit(" "), F.lit(1))), ", ")
    sepsis, pharmacy = F.col("code") == "A41.9", (F.col("code") == "T81.4") & F.col("interaction")
    lines = F.array(
        stamp(0, F.format_string("Triagem: dados do paciente carregados - %s, %s, %d anos", "code", "name", "age")),
        stamp(1, F.concat(F.lit("Consultando protocolo: "), "protocol")),
        stamp(2, F.concat(F.lit("Exames identificados: "), F.when(F.size("exam_names") == 0, "nenhum").otherwise(exams))),
        stamp(3, F.format_string("Acoes sugeridas geradas: %d itens - aguarda aprovacao medica", "n_items")),
        F.when(sepsis, "Caso critico detectado - alerta imediato para equipe medica"),
        F.when(pharmacy, "Possivel interacao medicamentosa detectada - encaminhado para farmacia"),
        stamp(4, F.lit("Alerta enviado: equipes notificadas conforme regras")),
        stamp(5, F.lit("Fluxo concluido")),
    )
    told = rows.select("id", sepsis.alias("sepsis_critical"), pharmacy.alias("pharmacy_interaction"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))
    return told.select("id", "line_no", "line", "sepsis_critical", "pharmacy_interaction")
