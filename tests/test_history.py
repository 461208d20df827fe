"""Histories: state at a time, at many times, appends, readmission as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import admissions, history
from cairnfield.plans import reference_data
from cairnfield.storage import scratch

LOG = "id string, v int, _at int, _seq long, _op string"


@pytest.fixture(scope="module")
def changes():
    rng = random.Random(6)
    ids = ["hot"] * 5 + ["a", "b", None]
    return [(rng.choice(ids), rng.randrange(100), rng.randrange(300), i, rng.choice(["put", "put", "delete"])) for i in range(900)]


def plainly(changes, at):
    state = {}
    for i, v, t, s, op in sorted(changes, key=lambda c: (c[2], c[3])):
        if t <= at:
            state[i] = v if op == "put" else None
    return {i: v for i, v in state.items() if v is not None}


def test_state_at(spark, changes):
    log = spark.createDataFrame(changes, LOG).repartition(4)
    for at in (-1, 0, 50, 299):
        assert {r.id: r.v for r in history.state_at(log, "id", F.lit(at)).collect()} == plainly(changes, at)
    assert {r.id: r.v for r in history.state_at(log, "id").collect()} == plainly(changes, 10**6)


@pytest.mark.parametrize("width", [1 << 20, 100])
def test_state_for(spark, changes, width):
    """Each asking row at its own time, also where one key has most of the log."""
    rng = random.Random(7)
    asks = [(rng.choice(["hot", "a", "b", "none", None]), rng.randrange(-5, 320), n) for n in range(400)]
    got = history.state_for(spark.createDataFrame(asks, "id string, t int, n int"), spark.createDataFrame(changes, LOG), "id", F.col("t"), "was", width).collect()
    assert len(got) == len(asks)
    for r in got:
        assert (r.was and r.was.v) == plainly(changes, r.t).get(r.id)


def test_append_is_idempotent(spark):
    path = scratch(spark, "history")
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    for batch, at in (("1", 0), ("2", 5), ("2", 5)):
        history.append(history.puts(rows.withColumn("v", F.lit(at)), F.lit(at)), path, batch)
    history.append(history.deletes(rows, "id", F.lit(9)), path, "3")
    log = history.log_of(spark, path)
    assert log.count() == 3 and [r.v for t in (0, 7, 9) for r in history.state_at(log, "id", F.lit(t)).collect()] == [0, 5]


def test_readmission(spark):
    tables = {
        "patients": spark.createDataFrame([(1, "p1", "discharged", "A41.9", "Sepse", "t0"), (2, "p2", "admitted", "A41.9", "Sepse", "t0"), (3, "p3", "discharged", "A41.9", "Sepse", "t0")], "id long, name string, status string, cid_code string, cid_label string, admitted_at string"),
        "exams": spark.createDataFrame([("ex-old", 1, "old", None, "completed", None, None), ("ex-2", 2, "kept", None, "pending", None, None)], "id string, patient_id long, name string, requested_at string, status string, source string, protocol_ref string"),
        "items": spark.createDataFrame([("sa-old", 1, "exam", None, "accepted", None)], "id string, patient_id long, type string, description string, status string, protocol_ref string"),
        "log": spark.createDataFrame([("al-1", 1, "admission", None, None, "t0")], "id string, patient_id long, step string, status string, detail string, timestamp string"),
        "vitals": spark.createDataFrame([("vs-1", 1, 99, "t0"), ("vs-0", 1, 60, "s0")], "id string, patient_id long, heart_rate int, recorded_at string"),
    }
    requests = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    changes, refused = history.readmission(tables, requests, reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, F.lit(1), "t1", ["recorded_at", "id"])
    assert [r.id for r in refused.collect()] == [2]
    after = {n: history.state_at(history.puts(t, F.lit(0)).unionByName(changes[n]), "id") for n, t in tables.items()}
    assert {(r.id, r.status, r.admitted_at) for r in after["patients"].collect()} == {(1, "admitted", "t1"), (2, "admitted", "t0"), (3, "discharged", "t0")}
    exams, items, _ = admissions.protocol_children(tables["patients"].filter("id = 1"), reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, "readmission", "t1")
    assert {r.id for r in after["exams"].collect()} == {"ex-2"} | {r.id for r in exams.collect()}
    assert {(r.id, r.status) for r in after["items"].collect()} == {(r.id, "suggested") for r in items.collect()}
    assert sorted((r.step, r.timestamp) for r in after["log"].collect()) == [("admission", "t0"), ("readmission", "t1")]
    assert sorted((r.heart_rate, r.recorded_at) for r in after["vitals"].collect()) == [(60, "s0"), (99, "t0"), (99, "t1")]
    assert all(after[n].columns == tables[n].columns for n in tables)


def test_passages_shuffle_only_what_was_found(spark):
    from cairnfield.operators import vectors

    found = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (1, 1, 7), (1, 2, 99)], "query_id long, rank int, vec_id long")
    docs = spark.createDataFrame([(7, "seven"), (8, None), (9, "nine")], "vec_id long, text string")
    told = vectors.passages(found, docs, "vec_id")
    assert sorted((r.query_id, r.rank, r.text) for r in told.collect()) == [(0, 1, "seven"), (0, 2, None), (1, 1, "seven"), (1, 2, None)]
    assert "LeftSemi" in told._jdf.queryExecution().executedPlan().toString()
