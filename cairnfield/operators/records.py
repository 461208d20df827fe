"""Patient records: optional filters, lookups, nested aggregates, carried-forward observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import last_given

#: Observations of a patient without any.
DEFAULT_VITALS = {"blood_pressure": "120/80", "temperature": 36.5, "oxygen_saturation": 97, "heart_rate": 72}


def where_truthy(df: DataFrame, column: str, value) -> DataFrame:
    """Equality if the value is truthy: None and the empty string mean no filter."""
    return df.filter(F.col(column) == value) if value else df


def where_given(df: DataFrame, column: str, value) -> DataFrame:
    """Equality unless the value is None: the empty string filters."""
    return df.filter(F.col(column) == value) if value is not None else df


def for_team(df: DataFrame, team: str | None, column: str = "team") -> DataFrame:
    """Rows of a team or of all teams."""
    return df.filter(F.col(column).isin(team, "all")) if team is not None else df


def matching(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Any column holds q, ignoring case; ``%`` and ``_`` in q are wildcards."""
    if not q:
        return df
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).cast("string").ilike(f"%{q}%")
    return df.filter(test)


def holding(df: DataFrame, q: str | None, *columns: str) -> DataFrame:
    """Any column holds the trimmed q literally, ignoring case; a blank q keeps all rows."""
    q = (q or "").strip().lower()
    if not q:
        return df
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.col(c).cast("string")).contains(q)
    return df.filter(test)


def by_key(df: DataFrame, **keys) -> DataFrame:
    """The row of a (composite) key: 0 or 1 rows if the key is one."""
    for c, v in keys.items():
        df = df.filter(F.col(c) == v)
    return df


def nested(children: DataFrame, key: str, name: str, *order: Column) -> DataFrame:
    """``key, name``: each parent's children as a sorted array of structs, sorted by the ``order`` columns first."""
    fields = [c for c in children.columns if c != key]
    row = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*fields).alias("row"))
    return children.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_a")).select(key, F.col("_a.row").alias(name))


def with_children(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents with each nested child, an empty array where there is none: one plan, no query per parent."""
    for c in children:
        name = next(n for n in c.columns if n != key)
        kind = c.schema[name].dataType
        parents = parents.join(c, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return parents


def carry_forward(patches: DataFrame, key: str, order: list[str], fields: dict[str, object]) -> DataFrame:
    """Each patch completed: a missing field is the last one given for the key, or the default."""
    told = last_given(patches, key, order, {c: F.col(c) for c in fields}, with_row=True)
    return told.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in fields.items()})


def fold_patches(patches: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The state after all sparse patches: each field's last value that is not null."""
    return patches.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields))


def replace_children(children: DataFrame, parents: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """Children of the given parents deleted and derived anew."""
    return children.join(parents.select(key), key, "left_anti").unionByName(fresh)


def fixed_groups(items: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """``column, n`` for each value of the domain, in its order, empty ones too; other values are dropped."""
    table = items.sparkSession.createDataFrame(list(enumerate(domain)), f"ordinal int, {column} string")
    counts = items.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(table).join(counts, column, "left").select("ordinal", column, F.coalesce("n", F.lit(0)).alias("n"))


def last_user_turn(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, text`` of each conversation's last user turn."""
    users = turns.filter(F.col("role") == "user")
    return users.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def grouped_items(items: DataFrame, parent: str, column: str, domain: list[str], *shown: str) -> DataFrame:
    """``parent, ordinal, column, items``: each parent's items by type, in the domain's order, empty groups too; items
    of other types are dropped. ``items`` is an array of the shown columns, sorted by them."""
    table = F.posexplode(F.array(*map(F.lit, domain)))
    every = items.select(parent).distinct().select(parent, table.alias("ordinal", column))
    found = items.filter(F.col(column).isin(domain)).groupBy(parent, column).agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("items"))
    kind = found.schema["items"].dataType
    return every.join(found, [parent, column], "left").select(parent, "ordinal", column, F.coalesce("items", F.array().cast(kind)).alias("items"))


def newest_first(rows: DataFrame, time: str, key: str, key_descends: bool = False) -> DataFrame:
    """Sorted by time, latest first; ties by key."""
    return rows.orderBy(F.desc(time), F.desc(key) if key_descends else F.asc(key))


def by_status(exams: DataFrame, tab: str, status: str = "status") -> DataFrame:
    """The exams of a tab: pending, completed, critical, or all."""
    return exams if tab == "all" else exams.filter(F.col(status) == tab)


def default_fields(name: Column, observations: Column, sex: Column) -> dict[str, Column]:
    """Name, observations and sex as a new patient has them where they are blank."""
    from ..functions.text import non_blank

    return {"name": non_blank(name, "Paciente sem nome"), "observations": non_blank(observations, "Não informado"), "sex": F.when(F.length(sex) > 0, sex).otherwise("M")}


def display_value(c: Column, is_list: bool = False) -> Column:
    """A metadata value as shown: null as a dash, a list joined by commas."""
    return F.coalesce(F.array_join(c, ", ") if is_list else c.cast("string"), F.lit("—"))
