"""Clinical scalar functions: pressures, defaults, tiers, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def systolic(c: Column) -> Column:
    """The number before ``/``; shorthand up to 30 counts tenfold ("19/11" is 190); null if there is none."""
    n = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("int")
    return F.when(n <= 30, n * 10).otherwise(n)


def clamp_age(c: Column) -> Column:
    return F.when(c.isNull(), 45).otherwise(F.least(F.lit(120), F.greatest(F.lit(0), c)))


def vital_tier(kind: Column, value: Column) -> Column:
    """The display tier: crit, warn or normal. Its oxygen limit (90) differs from the alert rule's (92)."""
    crit = (
        ((kind == "oxygen_saturation") & (value < 90))
        | ((kind == "temperature") & ((value >= 39) | (value < 35)))
        | ((kind == "heart_rate") & ((value > 120) | (value < 45)))
        | ((kind == "systolic") & (value >= 180))
    )
    warn = (
        ((kind == "oxygen_saturation") & (value < 94))
        | ((kind == "temperature") & (value >= 38))
        | ((kind == "heart_rate") & (value > 100))
        | ((kind == "systolic") & (value >= 140))
    )
    return F.when(crit, "crit").when(warn, "warn").otherwise("normal")


def vital_critical(kind: Column, value: Column) -> Column:
    """The alert rule's thresholds."""
    return (
        ((kind == "oxygen_saturation") & (value < 92))
        | ((kind == "temperature") & ((value >= 39) | (value < 35)))
        | ((kind == "heart_rate") & ((value > 120) | (value < 45)))
        | ((kind == "systolic") & (value >= 180))
    )


def selectable_code(c: Column) -> Column:
    """A letter and two digits first, and no hyphen (ranges and chapters are out)."""
    return F.coalesce(c.rlike(r"(?s)^\p{L}\p{Nd}{2}[^-]*$"), F.lit(False))


def unit_of(exam: Column) -> Column:
    return F.when(F.lower(exam).contains("lactato"), "mmol/L").otherwise("mg/dL")


def breadcrumb(h1: Column, h2: Column) -> Column:
    """``h1 > h2``, the one that is not blank, or the marker for no header."""
    part = lambda h: F.nullif(F.trim(h), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" > ", part(h1), part(h2)), F.lit("")), F.lit("(sem cabeçalho)"))


def citation(stem: Column, first: Column, last: Column) -> Column:
    say = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("PCDT "), say(stem), F.lit(" (pp. "), say(first), F.lit("-"), say(last), F.lit(")"))


# The wording around retrieved passages.
CONTEXT_GAP = "\n\n---\n\n"
NO_CONTEXT = "(Nenhum trecho recuperado.)"
QUESTION, CONTEXT, REQUEST = "Pergunta do médico:\n", "\n\nContexto (trechos PCDT):\n", "\n\nResponda com base no contexto quando aplicável."


def context_part(rank: Column, stem: Column, first: Column, last: Column, text: Column) -> Column:
    """A retrieved passage under its numbered header."""
    say = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] PCDT stem="), say(stem), F.lit(" págs. "), say(first), F.lit("-"), say(last), F.lit("\n"), strip(F.coalesce(text, F.lit(""))))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(QUESTION), F.coalesce(question, F.lit("")), F.lit(CONTEXT), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit(REQUEST))
