import math

from pyspark.sql import functions as F

from cairnfield.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(0))
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))


def test_ties_gaps_and_odd_vectors(spark):
    rows = [(i, [((i * 7 + d * 3) % 11 - 5) / 4 for d in range(6)]) for i in range(120)]
    rows += [(120, None), (121, [NAN, 1.0]), (122, [INF]), (123, [None, 1.0]), (None, [1.0]), (124, []), (125, [0.5]), (3, rows[3][1]), (50, rows[50][1])]
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, [(0, [1.0])]) == []


def test_large_components_are_exact_and_clamped(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 0.0])]
    assert [r[2:] for r in run(spark, rows)] == [(1, 2**63 - 1), (2, -(2**63))]


def test_blocks_by_either_plan(spark, monkeypatch):
    """Several query and candidate blocks, broadcast and dealt to groups."""
    from cairnfield.llm import common

    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rows = [(i, [((i * 13 + d * 5) % 17 - 8) / 8 for d in range(5)]) for i in range(700)]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert run(spark, rows) == want
