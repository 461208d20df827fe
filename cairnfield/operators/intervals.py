"""Which of a document's spans an interval touches, for intervals of any length.

Spans of a document lie one after the other, so those an interval touches are a run from the first that ends after its
start to the last that begins before its end. Each is an as-of lookup along one order of both sides: no pair of interval
and span is formed, a document of any size is cut into ranges by rank, and the span still open is carried from range to
range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import WIDTH, as_of, last_given


def touched(pieces: DataFrame, spans: DataFrame, key: str, start: str, end: str, value: str, width: int = WIDTH) -> DataFrame:
    """``pieces`` with ``first`` and ``last``: the ``value`` of the first and last span of the same ``key`` that each
    touches ([start, end) of both; an empty interval touches a span it lies inside); null where it touches none.

    Spans of a key must not cross: both their starts and their ends rise. Other columns of ``spans`` are not read."""
    told = spans.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    told = last_given(told, "_k", ["_s", "_e", "_v"], {"_open": F.col("_e")}, with_row=False, width=width)  # where the span before ends
    begins = F.coalesce(F.col("_open").cast("long"), F.lit(-(1 << 62)))
    named = told.withColumnRenamed("_k", key)
    last = as_of(pieces, named, key, F.col(end).cast("long") - 1, F.col("_s").cast("long"), ["_s", "_e", "_v"], "_last", width)
    both = as_of(last, named, key, F.col(start).cast("long"), begins, ["_s", "_e", "_v"], "_first", width)
    meets = lambda c: (F.col(c)["_s"] < F.col(end)) & (F.col(c)["_e"] > F.col(start))
    hit: Column = F.coalesce(meets("_first") & meets("_last"), F.lit(False))
    return both.select(*pieces.columns, *(F.when(hit, F.col(f"_{n}")["_v"]).alias(n) for n in ("first", "last")))


def page_ranges(pieces: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``pieces`` (``stem, start, end`` and others) with ``page_start, page_end`` of the spans (``stem, page, start,
    end``) that they touch; (1, 1) where they touch none."""
    told = touched(pieces, spans, "stem", "start", "end", "page", width)
    kept = [c for c in told.columns if c not in ("first", "last")]
    return told.select(*kept, *(F.coalesce(F.col(a).cast("long"), F.lit(1).cast("long")).alias(b) for a, b in (("first", "page_start"), ("last", "page_end"))))
