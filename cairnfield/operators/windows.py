"""Running totals, carried values and as-of lookups that never gather a hot key's rows in one task.

A group of at most ``WIDTH`` rows is a plain window. The rows of a group with more are numbered apart, sorted by range
partitioning on (group, order, number) and written: counted splitters cut them into ranges of about ``WIDTH`` rows, by
rank and not by value, so neither sparse nor repeated values of the order column matter. Each range's total is a row,
the totals run up over a group's ranges, and a window within the range adds the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import table_of

#: Rows of a group that one task holds.
WIDTH = 1 << 20


def ranges(df: DataFrame, group: list[str], order: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``width`` rows, the others with ``_range`` and ``_tie``, written, or None).

    Ranges are numbered in the order of (group, order, tie) and hold about ``width`` rows each; a range of one group
    ends where the next begins. Rows are counted by group first."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > width)
    hot = sizes.agg(F.sum("_rows").alias("n"), F.count("*").alias("groups")).first()
    if not hot["groups"]:
        return df, None
    named = table_of(sizes, "hot").select(*(F.col(g).alias(f"_h{i}") for i, g in enumerate(group)))
    side = F.broadcast(named) if hot["groups"] <= width else named  # one row for more than width rows
    on = [df[g].eqNullSafe(named[f"_h{i}"]) for i, g in enumerate(group)]
    tied = table_of(df.join(side, on, "left_semi").withColumn("_tie", F.monotonically_increasing_id()), "tied")
    dealt = tied.repartitionByRange(math.ceil(hot["n"] / width), *group, *order, "_tie")
    return df.join(side, on, "left_anti"), table_of(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _windowed(df: DataFrame, group: list[str], order: list[str], width: int, frame: tuple[int, int], inner: Callable[[WindowSpec], dict[str, Column]], total: list[Column], carried: Callable[[WindowSpec], list[Column]], joined: dict[str, Column]) -> DataFrame:
    """``inner`` over each group; for a hot one over its ranges, with what ``carried`` makes of the ranges before
    (``total``: columns of a range) put in by ``joined``."""
    plain, dealt = ranges(df, group, order, width)
    over = lambda keys, by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(*frame)
    out = plain.withColumns(inner(over(group, order)))
    if dealt is None:
        return out
    totals = table_of(dealt.groupBy(*group, "_range").agg(*total), "totals")
    n = totals.count()
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_range").alias("_r"), *carried(before))
    placed = dealt.repartitionByRange(max(1, n), "_range").withColumns(inner(over([*group, "_range"], [*order, "_tie"])))
    on = [placed["_range"] == F.col("_r"), *(placed[g].eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group))]
    told = placed.join(F.broadcast(starts) if n <= width else starts, on).withColumns(joined)  # a row for each range of a group
    return out.unionByName(told.select(*out.columns))


def running_sums(df: DataFrame, group: list[str], order: str | list[str], values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Adds each column of ``values``: its sum over the group's rows before this one, in ``order``."""
    order, names = [order] if isinstance(order, str) else order, list(values)
    if not group:
        return running_sums(df.withColumn("_all", F.lit(0)), ["_all"], order, values, width).drop("_all")
    valued = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    told = _windowed(
        valued, group, order, width, (Window.unboundedPreceding, -1),
        inner=lambda w: {f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(w), F.lit(0)) for i in range(len(names))},
        total=[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))],
        carried=lambda w: [F.coalesce(F.sum(f"_s{i}").over(w), F.lit(0)).alias(f"_b{i}") for i in range(len(names))],
        joined={f"_i{i}": F.col(f"_b{i}") + F.col(f"_i{i}") for i in range(len(names))},
    )
    return told.select(*(c for c in df.columns if c not in values), *(F.col(f"_i{i}").alias(n) for i, n in enumerate(names)))


def running_sum(df: DataFrame, group: list[str], order: str | list[str], value: Column, out: str, width: int = WIDTH) -> DataFrame:
    return running_sums(df, group, order, {out: value}, width)


def last_given(df: DataFrame, key: str, order: list[str], values: dict[str, Column], with_row: bool, width: int = WIDTH) -> DataFrame:
    """Adds each column of ``values``: its last value that is not null over the key's rows up to this one (``with_row``)
    or before it, by ``order``; null where there is none."""
    names = list(values)
    valued = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)})
    at = lambda i: F.when(F.col(f"_v{i}").isNotNull(), F.struct(*order, "_tie"))
    told = _windowed(
        valued, [key], order, width, (Window.unboundedPreceding, 0 if with_row else -1),
        inner=lambda w: {f"_i{i}": F.last(f"_v{i}", ignorenulls=True).over(w) for i in range(len(names))},
        total=[F.max_by(f"_v{i}", at(i)).alias(f"_e{i}") for i in range(len(names))],
        carried=lambda w: [F.last(f"_e{i}", ignorenulls=True).over(w).alias(f"_b{i}") for i in range(len(names))],
        joined={f"_i{i}": F.coalesce(f"_i{i}", f"_b{i}") for i in range(len(names))},
    )
    given = {n: F.col(f"_i{i}") for i, n in enumerate(names)}
    return told.select(*(given.pop(c).alias(c) if c in given else F.col(c) for c in df.columns), *(c.alias(n) for n, c in given.items()))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: Column, right_at: Column, values: list[str], out: str, width: int = WIDTH) -> DataFrame:
    """``left`` with ``out``: the struct of ``values`` of the key's last row of ``right`` whose ``right_at`` is at most
    ``left_at``, null where there is none; of several at one place the greatest. Rows of both sides are put in one order
    and values carried along it: one shuffle of each, and no product of a key's rows."""
    found, row = F.struct(*values), F.struct(*left.columns)
    sides = [
        left.select(F.col(key).alias("_key"), left_at.alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(found.alias("s")).schema["s"].dataType).alias(out), row.alias("_row")),
        right.select(F.col(key).alias("_key"), right_at.alias("_at"), F.lit(0).alias("_side"), found.alias(out), F.lit(None).cast(left.select(row.alias("s")).schema["s"].dataType).alias("_row")),
    ]
    told = last_given(sides[0].unionByName(sides[1]), "_key", ["_at", "_side", out], {"_found": F.col(out)}, with_row=True, width=width)
    return told.filter("_side = 1").select(*(F.col("_row")[c].alias(c) for c in left.columns), F.col("_found").alias(out))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order columns; combined before the shuffle, so hot keys don't gather."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in rest))


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return best.select(*key, *(F.col("_row")[c].alias(c) for c in rest))


def with_least(df: DataFrame, key: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: the least ``value`` of each row's key. Keys are counted while that is found: those of more than
    ``width`` rows, of which there are few, are broadcast, and only the others' rows are shuffled to them."""
    found = table_of(df.groupBy(key).agg(F.min(value).alias("_least"), F.count("*").alias("_rows")), "least").withColumnRenamed(key, "_key")
    hot = found.filter(F.col("_rows") > width)
    met = lambda rows, side: rows.join(side, rows[key].eqNullSafe(side["_key"])).select(*df.columns, F.col("_least").alias(out))
    n = hot.count()
    if not n:
        return met(df, found)
    side = F.broadcast(hot) if n <= width else hot  # one row for more than width rows
    rest = df.join(side.select("_key"), df[key].eqNullSafe(F.col("_key")), "left_anti")
    return met(df, side).unionByName(met(rest, found.filter(F.col("_rows") <= width)))
