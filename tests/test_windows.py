"""Windows over ranges by rank: plain computations, hot groups, sparse and repeated order values."""

import random

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import intervals, windows

WIDTH = 500


def largest_over_mean(dealt):
    n = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    return max(n) * len(n) / sum(n)


@pytest.mark.parametrize("kind", ["hashed", "one day"])
def test_ranges_are_even(spark, kind):
    """Ids all over the range of a long, and one value of the order column in every row."""
    rows = spark.range(50_000).select(F.lit("a").alias("k"), (F.xxhash64("id") if kind == "hashed" else F.lit(7)).alias("o"), F.lit(1).alias("v"), "id")
    plain, dealt = windows.ranges(rows, ["k"], ["o"], 2_000)
    assert plain.count() == 0 and dealt.count() == 50_000
    assert 20 <= dealt.select("_range").distinct().count() <= 30 and largest_over_mean(dealt) < 2
    told = windows.running_sum(rows, ["k"], "o", F.col("v"), "before", width=2_000)
    assert told.agg(F.sum("before"), F.count_distinct("before"), F.max("before")).first()[:] == (50_000 * 49_999 // 2, 50_000, 49_999)


def test_hot_and_small_groups_together(spark):
    rng = random.Random(3)
    data = [(("hot", None, f"k{i % 40}")[min(2, i % 4)], rng.randrange(-(2**40), 2**40), rng.choice([None, i]), i) for i in range(6_000)]
    df = spark.createDataFrame(data, "k string, o long, v int, i int").repartition(5)
    sums = {r.i: r.s for r in windows.running_sums(df, ["k"], ["o", "i"], {"s": F.coalesce("v", F.lit(0))}, width=WIDTH).collect()}
    last = {w: {r.i: r.u for r in windows.last_given(df, "k", ["o", "i"], {"u": F.col("v")}, w, width=WIDTH).collect()} for w in (True, False)}
    state = {}
    for k, _, v, i in sorted(data, key=lambda r: (r[1], r[3])):
        total, seen = state.get(k, (0, None))
        assert sums[i] == total and last[False][i] == seen
        state[k] = total + (v or 0), v if v is not None else seen
        assert last[True][i] == state[k][1]
    assert len(sums) == len(last[True]) == 6_000


def test_a_value_column_may_be_replaced(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None)], "k int, o int, v int")
    got = windows.last_given(df, "k", ["o"], {"v": F.col("v")}, True)
    assert got.columns == ["k", "o", "v"] and [r.v for r in got.orderBy("o").collect()] == [None, 5, 5]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, o int, v int")
    assert windows.running_sum(df, ["k"], "o", F.col("v"), "s").count() == 0 and windows.last_given(df, "k", ["o"], {"u": F.col("v")}, True).count() == 0


@pytest.mark.parametrize("width", [windows.WIDTH, 300])
def test_as_of(spark, width):
    rng = random.Random(4)
    right = [(rng.choice(["a", "b", None]), rng.randrange(1_000), i) for i in range(1_500)]
    left = [(rng.choice(["a", "b", "c", None]), rng.randrange(1_100), i) for i in range(1_500)]
    got = windows.as_of(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int"), "k", F.col("t"), F.col("t"), ["v", "t"], "found", width)
    assert got.columns == ["k", "t", "i", "found"]
    for r in got.collect():
        want = max(((t, v) for k, t, v in right if k == r.k and t <= r.t), default=None)
        assert (r.found and (r.found.t, r.found.v)) == want
    assert got.count() == len(left)


@pytest.mark.parametrize("width", [windows.WIDTH, 200])
def test_page_ranges(spark, width):
    """Pieces of any length, overlapping each other, against a look at every span; empty pages, gaps, unknown stems."""
    rng = random.Random(5)
    spans, pieces = [], []
    for stem, n in (("a", 400), ("b", 30), ("c", 1), (None, 12)):
        at = rng.randrange(3)
        for page in range(1, n + 1):
            size = rng.choice([0, 0, 1, 5, 40, 300])
            spans.append((stem, page, at, at + size))
            at += size + 2
        for i in range(3 * n):
            lo = rng.randrange(at + 5)
            pieces.append((stem, i, lo, lo + rng.choice([0, 1, 3, 50, 2_000])))
    pieces.append(("unknown", 0, 0, 10))
    got = intervals.page_ranges(spark.createDataFrame(pieces, "stem string, chunk int, start long, end long"), spark.createDataFrame(spans, "stem string, page int, start long, end long"), width=width)
    assert got.columns == ["stem", "chunk", "start", "end", "page_start", "page_end"] and got.count() == len(pieces)
    for r in got.collect():
        touched = [p for s, p, a, b in spans if s == r.stem and r.start < b and r.end > a]
        assert (r.page_start, r.page_end) == ((min(touched), max(touched)) if touched else (1, 1)), r


@pytest.mark.parametrize("width", [windows.WIDTH, 200])
def test_with_least(spark, width):
    rng = random.Random(15)
    data = [(rng.choice(["hot"] * 9 + [None, "a", "b"]), rng.randrange(10_000)) for _ in range(2_000)]
    got = windows.with_least(spark.createDataFrame(data, "k string, v int"), "k", "v", "least", width)
    assert got.columns == ["k", "v", "least"] and sorted(map(str, got.collect())) == sorted(f"Row(k={k!r}, v={v}, least={min(w for j, w in data if j == k)})" for k, v in data)
