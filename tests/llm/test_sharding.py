import zlib

from pyspark.sql import functions as F

from cairnfield.llm import sharding


def test_whole_table(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(3000)] + [(7, "hot")] * 1500 + [(None, None), (9001, None), (9002, "")]
    root = sharding.tree()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(-1))
    got = sharding.assign(df, root, sharding.grow(root)).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i if i else (-1 if i is None else 0) or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and slots
    moved = [r for r in got if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 24 for r in moved) and all(r.law == "key" for r in got)
    places = {}
    assert all(places.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) for r in got)


def test_weights_move_rows_only_through_changed_subtrees(spark):
    keys = spark.range(4000)
    before = sharding.tree(2, 2, 2)
    after = sharding.tree(2, 2, 2)
    after.children[0].children[1].children[0].own = 3.0  # shard 2
    rows = keys.select(sharding.shard_of(F.col("id"), before).alias("a"), sharding.shard_of(F.col("id"), after).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(a in (0, 1, 2, 3) or b in (0, 1, 2, 3) for a, b in moved)
    assert not any({a, b} <= {4, 5, 6, 7} for a, b in moved) and not any({a, b} <= {0, 1} for a, b in moved)
    assert sum(r.b == 2 for r in rows) > 2 * sum(r.a == 2 for r in rows)


def test_weight_zero_and_empty(spark):
    root = sharding.tree(1, 1, 3)
    root.children[0].children[0].children[1].own = 0.0
    got = {r[0] for r in spark.range(300).select(sharding.shard_of(F.col("id"), root)).collect()}
    assert got == {0, 2}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(none, sharding.tree(), sharding.grow(sharding.tree())).count() == 0


def xxhash(text):
    import xxhash as x

    return x.xxh64(text.encode(), seed=42).intdigest()


def test_against_a_plain_weighted_draw(spark):
    """The shard of every key by a walk down the tree in plain Python."""
    import math

    root = sharding.tree(2, 2, 3)
    root.children[1].children[0].children[2].own = 2.5

    def walk(key, node):
        while node.children:
            draws = []
            for c in node.children:
                u = ((xxhash(f"{key}|{c.name}") >> 11) + 0.5) / (1 << 53)
                draws.append((-math.log(u) / c.weight, c.name, c))
            node = min(draws)[2]
        return node.shard

    rows = spark.range(1500).select("id", sharding.shard_of(F.col("id"), root).alias("s")).collect()
    assert all(r.s == walk(r.id, root) for r in rows)


def test_a_text_of_megabytes(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000)], "doc_id long, text string")
    [r] = sharding.assign(df, sharding.tree(), sharding.grow(sharding.tree())).collect()
    assert r.size == 4_000_008 and r.text_crc32 == zlib.crc32(("é" * 2_000_000).encode())
