"""Unique codes by rounds of claims, against the loop over all labels in order."""

import random

import pytest

from cairnfield.operators import catalogs


def in_order(labels, used):
    taken, out = set(used), []
    for ordinal, label in sorted(labels):
        code, k = label, 2
        while code in taken:
            code, k = f"{label}_{k}", k + 1
        taken.add(code)
        out.append((ordinal, label, code))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_codes_that_meet(spark, seed):
    """Bases that are suffixes of others, three deep, used codes in between; some with large runs."""
    r = random.Random(seed)
    names = ["A", "A_2", "A_3", "A_2_2", "A_7", "B", "B_2", "B_1", "B_02", "C_9", "A_2_2_2", "A_40"]
    labels = [(o, r.choices(names, [20, 4, 3, 3, 1, 8, 6, 1, 1, 1, 1, 1])[0]) for o in r.sample(range(-500, 5000), 260)]
    used = r.sample(["A_5", "A", "B_2", "A_2_3", "C_9", "C_9_2", "A_12", "Z"], 4)
    got = catalogs.unique_codes(spark.createDataFrame(labels, "ordinal long, label string"), spark.createDataFrame([(u,) for u in used], "code string"), width=[1 << 20, 50][seed % 2])
    assert sorted(map(tuple, got.collect())) == in_order(labels, used)


def test_a_hot_base(spark):
    """One base with most labels, and contested places along its run: no range of it holds more than twice the width."""
    from cairnfield.operators import windows

    labels = [(i, "HOT" if i % 10 else f"HOT_{i // 7 + 2}") for i in range(6_000)]
    used = [f"HOT_{k}" for k in range(5, 3_000, 41)]
    df = spark.createDataFrame(labels, "ordinal long, label string")
    got = catalogs.unique_codes(df, spark.createDataFrame([(u,) for u in used], "code string"), width=700)
    assert sorted(map(tuple, got.collect())) == in_order(labels, used)
    _, dealt = windows.ranges(df, ["label"], ["ordinal"], 700)
    assert max(r["count"] for r in dealt.groupBy("_range").count().collect()) <= 1400


def test_none(spark):
    empty, used = spark.createDataFrame([], "ordinal long, label string"), spark.createDataFrame([("A",)], "code string")
    assert catalogs.unique_codes(empty, used).count() == 0
