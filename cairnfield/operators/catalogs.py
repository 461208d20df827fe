"""Reference catalogs: extraction, merging by normalised names, codes, search, prioritised lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_base, norm_header, norm_key, norm_space, sanitize_name
from ..storage import table_of
from .windows import WIDTH, as_of, first_of, running_sum

#: What the four columns of a medication table's header hold, and the form of a code.
HEADERS = ("denominacao comum", "concentracao", "forma farmaceutica", "codigo atc")
ATC = r"^[A-Z][0-9]{2}[A-Z0-9]{1,5}$"
TAG = "RENAME-2024"
#: A code with a number suffix: what it is a later code of, and at which place.
SUFFIXED = r"^(.+)_([1-9][0-9]{0,17})$"


def extract(tables: DataFrame) -> DataFrame:
    """``ordinal, name`` from table rows (``table_id, row_no, cells array<string>``, row 0 the header): tables with all
    four columns, rows with a well-formed code; the first of each normalised name."""
    heads = tables.filter("row_no = 0").select("table_id", F.posexplode("cells").alias("p", "h")).withColumn("h", norm_header(F.col("h")))
    full = heads.groupBy("table_id").agg(*(F.min(F.when(F.col("h").contains(w), F.col("p") + 1)).alias(f"p{i}") for i, w in enumerate(HEADERS))).dropna()
    rows = tables.filter("row_no > 0").join(full, "table_id")
    cell = lambda p: F.try_element_at("cells", F.col(p).cast("int"))
    coded = rows.filter(F.upper(norm_space(F.coalesce(cell("p3"), F.lit("")))).rlike(ATC)).withColumn("name", sanitize_name(cell("p0"))).filter("name != ''")
    keyed = coded.select(norm_key(F.col("name")).alias("key"), F.struct("table_id", "row_no").alias("ordinal"), "name")
    return first_of(keyed, ["key"], "ordinal").select("ordinal", "name")


def merge(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """``code, label, active_ingredient, source_tags, is_new``.

    Catalog: ``ordinal, code, label, active_ingredient, source_tags``; names: ``ordinal, name``. A name matches an
    entry by the key of its label or ingredient, the later entry where a key is in several; matched entries get the
    tag once. Names without a match become entries, the first of each key; their code is the base code, to be made
    unique by ``unique_codes``."""
    tags = F.array_distinct("source_tags")
    entries = catalog.withColumn("source_tags", tags)
    keys = entries.select("ordinal", "code", F.explode(F.array_distinct(F.array(norm_key(F.col("label")), norm_key(F.col("active_ingredient"))))).alias("key"))
    owner = keys.groupBy("key").agg(F.max_by("code", "ordinal").alias("code"))
    clean = names.withColumn("label", sanitize_name(F.col("name"))).filter("label != ''").withColumn("key", norm_key(F.col("label")))
    wanted = first_of(clean.select("key", "ordinal", "label"), ["key"], "ordinal")
    found = wanted.join(owner, "key", "left")
    hit = found.filter("code is not null").select("code").distinct().withColumn("_hit", F.lit(True))
    old = entries.join(hit, "code", "left").select("code", "label", "active_ingredient", F.when(F.col("_hit"), F.array_distinct(F.concat("source_tags", F.array(F.lit(TAG))))).otherwise(F.col("source_tags")).alias("source_tags"), F.lit(False).alias("is_new"))
    new = found.filter("code is null").select(code_base(F.col("label")).alias("code"), "label", F.col("label").alias("active_ingredient"), F.array(F.lit(TAG)).alias("source_tags"), F.lit(True).alias("is_new"))
    return old.unionByName(new)


def unique_codes(labels: DataFrame, used: DataFrame, width: int = WIDTH) -> DataFrame:
    """``ordinal, label, code``: in order of ``ordinal``, each label's base code, or its least suffix ``_2, _3 ...`` that
    is free.

    Labels of one base take ever higher suffixes, so a label's is its rank in the base and one more for each suffix
    skipped before it. Only two bases can want one code: ``X_2`` is the second of X and the first of X_2. So all bases
    claim by rank at once; a contested code goes to the base whose label comes first, the other skips it, which moves the
    ranks after it, and the claims are made again until none moves. Ranks and skips are running counts: a base with very
    many labels is many tasks."""
    asked = labels.select(F.col("ordinal").cast("long").alias("ordinal"), "label", code_base(F.col("label")).alias("base"))
    asked = table_of(running_sum(asked, ["base"], "ordinal", F.lit(1), "rank", width), "asked")
    bases = table_of(asked.groupBy("base").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")), "bases")
    contested = _contested(bases, used)
    if contested.limit(1).isEmpty():
        return asked.select("ordinal", "label", _suffixed(F.col("base"), F.col("rank") + 1).alias("code"))
    skips = _settled(contested, asked, width)
    counted = running_sum(skips.select("base", "at", "place"), ["base"], ["at", "place"], F.lit(1), "before", width)
    told = as_of(asked, counted.withColumn("skipped", F.col("before") + 1), "base", F.col("rank"), F.col("at"), ["skipped"], "_s", width)
    place = F.col("rank") + 1 + F.coalesce(F.col("_s.skipped"), F.lit(0))
    return told.select("ordinal", "label", _suffixed(F.col("base"), place).alias("code"))


def _suffixed(base: Column, place: Column) -> Column:
    """The base's code at a place: the base itself at 1."""
    return F.when(place == 1, base).otherwise(F.concat(base, F.lit("_"), place.cast("string")))


def _contested(bases: DataFrame, used: DataFrame) -> DataFrame:
    """``base, place, first, parent, parent_place``: places of a base's codes that are not its alone.

    ``first``: the ordinal of the label that asks for the code as its own base (the least long where the code is used);
    null at place 1 of a base that a ``parent`` base reaches at ``parent_place``."""
    taken = used.select("code").distinct().select(F.col("code").alias("code"), F.lit(-(2**63)).cast("long").alias("first"))
    rivals = taken.unionByName(bases.select(F.col("base").alias("code"), "first")).groupBy("code").agg(F.min("first").alias("first"))
    parts = rivals.select("code", "first", F.regexp_extract("code", SUFFIXED, 1).alias("base"), F.regexp_extract("code", SUFFIXED, 2).try_cast("long").alias("place"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("parent", "string"), ("parent_place", "long"))]
    below = parts.filter("place >= 2").join(bases.select("base", "n"), "base")
    below = table_of(below.select("code", "base", "place", "first"), "below")
    own = below.join(bases.select(F.col("base").alias("code")), "code", "left_semi").select(F.col("code").alias("base"), F.lit(1).cast("long").alias("place"), F.lit(None).cast("long").alias("first"), F.col("base").alias("parent"), F.col("place").alias("parent_place"))
    held = taken.join(bases.select(F.col("base").alias("code")), "code", "left_semi").select(F.col("code").alias("base"), F.lit(1).cast("long").alias("place"), "first", *none)
    own = own.join(held.select("base"), "base", "left_anti")
    return table_of(below.select("base", "place", "first", *none).unionByName(own).unionByName(held), "contested")


def _settled(contested: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """``base, place, at`` of the places that bases skip; ``at``: the rank that skips it first. Claims by rank, repeated
    until none moves: a claim depends on lower places of its base and on its parent's claims alone, so each round settles
    those whose grounds are settled."""
    claims = table_of(contested.withColumns({"at": F.lit(None).cast("long"), "skip": F.lit(False), "taken": F.lit(False)}), "claims")
    ranks = asked.select(F.col("base").alias("_b"), F.col("rank").alias("_r"), F.col("ordinal").alias("_o"))
    while True:
        ranked = running_sum(claims.withColumnRenamed("at", "was_at").withColumnsRenamed({"skip": "was", "taken": "had"}), ["base"], "place", F.col("was").cast("int"), "skips", width)
        ranked = ranked.withColumn("at", F.col("place") - 1 - F.col("skips"))
        met = ranked.join(ranks, (ranked["base"] == ranks["_b"]) & (ranked["at"] == ranks["_r"]), "left")
        above = claims.filter("taken").select(F.col("base").alias("_p"), F.col("place").alias("_pp"), F.lit(True).alias("_taken"))
        both = met.join(above, (F.col("parent") == F.col("_p")) & (F.col("parent_place") == F.col("_pp")), "left")
        skip = F.coalesce(F.when(F.col("parent").isNotNull(), F.col("_taken")).otherwise(F.col("first") < F.col("_o")), F.lit(False))
        moved = both.select(*contested.columns, "at", "was", "had", skip.alias("skip"), (F.col("_o").isNotNull() & ~skip).alias("taken"))
        now = table_of(moved, "claims")
        if now.filter("skip != was or taken != had").limit(1).isEmpty():
            return now.filter("skip").select("base", "place", "at")
        claims = now.drop("was", "had")


def sorted_list(catalog: DataFrame, label: str) -> DataFrame:
    return catalog.orderBy(F.lower(label), label)


def unselected(options: DataFrame, selected: DataFrame, label: str) -> DataFrame:
    """Options whose label, ignoring case, is not selected."""
    return options.join(selected.select(F.lower(label).alias("_l")).distinct(), F.lower(options[label]) == F.col("_l"), "left_anti")


def apply_protocols(patients: DataFrame, code: str, protocols: DataFrame, default: dict) -> DataFrame:
    """Patients with their code's protocol (``code, protocol_ref, exams, actions, interaction``), or the default."""
    side = protocols.withColumnRenamed("code", "_code")
    other = {"protocol_ref": F.lit(default["protocol_ref"]), "exams": F.array(*map(F.lit, default["exams"])), "actions": F.array(*(F.struct(F.lit(t).alias("type"), F.lit(d).alias("description")) for t, d in default["actions"])), "interaction": F.lit(False)}
    joined = patients.join(side, F.col(code) == F.col("_code"), "left")
    return joined.select(*patients.columns, *(F.when(F.col("_code").isNull(), v).otherwise(F.col(k)).alias(k) for k, v in other.items()))


def prioritised(rows: DataFrame, code: str, table: DataFrame, prefixes: dict[str, str], default: str) -> DataFrame:
    """Adds ``answer``: by the exact code, else by its first prefix's code, else the default's."""
    choose = F.lit(None).cast("string")
    for prefix, target in reversed(prefixes.items()):
        choose = F.when(F.col(code).startswith(prefix), target).otherwise(choose)
    exact, near = (table.select(F.col("code").alias(f"_{k}"), F.col("answer").alias(f"_{k}a")) for k in "en")
    other = table.filter(F.col("code") == default).select(F.col("answer").alias("_da")).withColumn("_one", F.lit(1))
    told = rows.withColumn("_p", choose).withColumn("_one", F.lit(1)).join(exact, F.col(code) == F.col("_e"), "left").join(near, F.col("_p") == F.col("_n"), "left").join(other, "_one", "left")
    return told.select(*rows.columns, F.coalesce("_ea", "_na", "_da").alias("answer"))


def with_labels(rows: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """Adds ``label`` of the code, by ``table`` (``code, label``), or the code itself where it is not there."""
    side = table.select(F.col("code").alias("_c"), F.col("label").alias("_l"))
    return rows.join(side, rows[code] == F.col("_c"), "left").select(*rows.columns, F.coalesce("_l", code).alias("label"))


def usable_codes(library: DataFrame | None, fallback: DataFrame, selectable) -> DataFrame:
    """``code, label`` of the library's codes that pass ``selectable``; the fallback where there is no library or none
    of its codes passes."""
    found = library.filter(selectable(F.col("code"))).select("code", "label") if library is not None else None
    return fallback.select("code", "label") if found is None or found.limit(1).isEmpty() else found


def toggle(selected, item):
    """An array with the item taken out if it is there, else added at the end."""
    return F.when(F.array_contains(selected, item), F.array_remove(selected, item)).otherwise(F.array_append(selected, item))
