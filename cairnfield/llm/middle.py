"""Fill-in-middle transformation by counted quantifiers.

A text is a row of units: white space and the word after it, or white space at the end. ``regexp_count`` gives their
number n; two hash draws cut 0..n into prefix, middle and suffix. A pattern made for the row, with possessive groups
``(unit){a}`` and ``(unit){b-a}``, captures the three parts in one match, and the replacement puts them in the form's
order. Possessive groups loop instead of recursing, so a text of any length fits a task's stack.

Defined results: a null text is empty, an empty one and one that holds a mark stays plain; a null id draws as the text
``null``; repeated rows come out alike; an empty table gives no rows. Other columns are kept by ``transform``, but those
whose names begin with ``fim_`` or ``_fim_``, and not read. Builtins only: no Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit, and the marks before prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"
#: What the replacement does with the groups prefix, middle, suffix.
ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
SEED, PERCENT, SPM_PERCENT = 42, 50, 80


def draws(id_col: Column, seed: int = SEED, n: int = 4) -> list[Column]:
    """The first ``n`` unsigned 32-bit numbers of the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with ``fim_n`` units, ``fim_form`` (plain, psm, spm) and ``fim_output``, the transformed text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    counted = docs.withColumns({"fim_n": F.regexp_count(text, F.lit(UNIT)).cast("long"), "fim_form": form, "_fim_h1": h1, "_fim_h2": h2})
    at = [F.col(h) % (F.col("fim_n") + 1) for h in ("_fim_h1", "_fim_h2")]
    cut = counted.withColumns({"_fim_a": F.least(*at), "_fim_b": F.greatest(*at)})
    group = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit("(?s)^"), group(F.col("_fim_a")), group(F.col("_fim_b") - F.col("_fim_a")), F.lit("(.*)$"))
    order = F.when(F.col("fim_form") == "psm", ORDERS["psm"]).otherwise(ORDERS["spm"])
    output = F.when(F.col("fim_form") == "plain", text).otherwise(F.regexp_replace(text, pattern, order))
    return cut.withColumn("fim_output", output).drop("_fim_h1", "_fim_h2", "_fim_a", "_fim_b")


def parts(output: Column, form: Column) -> Column:
    """The struct prefix, middle, suffix that a transformed text holds, null for a plain one. The parts hold no mark,
    and none can arise where a part meets a mark, so cutting at marks is exact."""
    cut = F.split(output, MARK, -1)
    one = lambda psm, spm: F.when(form == "psm", cut[psm]).otherwise(cut[spm])
    return F.when(form != "plain", F.struct(one(1, 2).alias("prefix"), cut[3].alias("middle"), one(2, 1).alias("suffix")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` began with (empty for a null one)."""
    told = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(told["prefix"], told["middle"], told["suffix"]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every row."""
    told = transform(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    output, form = F.col("fim_output"), F.col("fim_form")
    cut = told.select("doc_id", F.col("fim_n").alias("n"), form.alias("form"), output.alias("_output"), parts(output, form).alias("_parts"))
    back = F.when(F.col("form") == "plain", F.col("_output")).otherwise(F.concat("_parts.prefix", "_parts.middle", "_parts.suffix"))
    chars = [F.length(f"_parts.{p}").cast("long").alias(f"{p}_chars") for p in ("prefix", "middle")]
    return cut.select("doc_id", "n", "form", *chars, F.sha2("_output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), x AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
