"""Streams by event time: any cut into batches, late and repeated rows."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cairnfield.streaming import ordered

UPDATE = "id string, patient_id string, at timestamp, seq long, name string, status string, result string"
BEGIN = datetime(2024, 1, 1)


def fed(spark, folder, rows, cuts, schema, start):
    """Files of the rows between the cuts, each a batch of the stream that ``start`` makes."""
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        if a < b:
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")).awaitTermination(120)
    return spark.read.parquet(f"{folder}/out")


@pytest.fixture(scope="module")
def updates():
    """Updates within five minutes of their order, then one far later that moves the watermark past all."""
    rng = random.Random(11)
    rows = []
    for i in range(120):
        at = BEGIN + timedelta(minutes=i) + timedelta(seconds=rng.randrange(-150, 150))
        rows.append((f"e{rng.randrange(4)}", "p", at, i, "Exame", rng.choice(["critical", "critical", "pending", None]), rng.choice([None, "", "9"])))
    return rows, ("flush", "p", BEGIN + timedelta(days=1), 999, "x", "pending", None)


def alerts_of(rows):
    before, out = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        if r[5] == "critical" != before.get(r[0]):
            out.append((r[0], r[3]))
        before[r[0]] = r[5]
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [60], [20, 47, 90]])
def test_any_cut_gives_the_batch_alerts(spark, tmp_path, updates, cuts):
    rows, flush = updates
    got = fed(spark, tmp_path, [*rows, flush], [*cuts, len(rows)], UPDATE, lambda s: ordered.ordered_critical_stream(s, f"{tmp_path}/out", f"{tmp_path}/check", late="6 minutes"))
    assert sorted((r.id, r.seq) for r in got.collect()) == alerts_of(rows)
    assert {r.message for r in got.collect()} <= {"Resultado crítico registrado para Exame: sem valor informado.", "Resultado crítico registrado para Exame: 9."}


def test_a_key_is_forgotten(spark, tmp_path):
    """Two critical updates a day apart: one alert, or two where the status is forgotten after an hour."""
    rows = [("e", "p", BEGIN, 0, "n", "critical", None), ("f", "p", BEGIN + timedelta(hours=5), 1, "n", "pending", None), ("f", "p", BEGIN + timedelta(hours=6), 2, "n", "pending", None), ("e", "p", BEGIN + timedelta(days=1), 3, "n", "critical", None), ("f", "p", BEGIN + timedelta(days=2), 4, "n", "pending", None)]
    for forget, want in ((None, [0]), (3_600_000, [0, 3])):
        folder = tmp_path / str(forget)
        got = fed(spark, folder, rows, [1, 3], UPDATE, lambda s, f=folder, t=forget: ordered.ordered_critical_stream(s, f"{f}/out", f"{f}/check", late="1 minute", forget_ms=t))
        assert sorted(r.seq for r in got.collect()) == want


class Calls:
    """State of one key that is held here; counts the calls made, each of which is one to the JVM."""

    def __init__(self):
        self.made, self.timers = 0, set()

    def getValueState(self, name, schema):
        return Value(self)

    def registerTimer(self, t):
        self.made += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.made += 1
        self.timers.discard(t)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.made += 1
        return self.value

    def update(self, value):
        self.calls.made += 1
        self.value = value

    def clear(self):
        self.update(None)


def test_calls_to_the_state_do_not_grow_with_the_rows():
    fields = StructType([StructField("at_us", LongType()), StructField("seq", LongType()), StructField("status", StringType())])
    for n in (1, 500):
        calls = Calls()
        edges = ordered.OrderedEdges(fields, "critical", None)
        edges.init(calls)
        rows = pd.DataFrame([(1000 * (n - i), i, "critical") for i in range(n)], columns=fields.names)
        calls.watermark = 0
        assert not list(edges.handleInputRows(("k",), iter([rows]), calls)) and calls.made <= 4 and calls.timers == {1}
        calls.made, calls.watermark = 0, n
        told = list(edges.handleExpiredTimer(("k",), calls, None))
        assert [t["seq"].tolist() for t in told] == [[n - 1]] and calls.made <= 5 and not calls.timers


EVENT = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture(scope="module")
def events():
    """In order, out of order within five minutes, repeated, and a few hours late in a later file."""
    rng = random.Random(13)
    rows = [(i, BEGIN + timedelta(minutes=2 * i, seconds=rng.randrange(-120, 120)), i % 3, rng.choice("ab")) for i in range(200)]
    rows = [r for r in rows for _ in range(1 + (r[0] % 9 == 0))]
    late = [(900 + i, BEGIN + timedelta(minutes=10 * i), 0, "late") for i in range(5)]
    return [*rows[:120], *late, *rows[120:], (999, BEGIN + timedelta(days=3), 9, "flush")], [120, 120 + len(late)]


def counted(rows, cuts):
    """The rows that count: each id once, without those that a batch brings later than the watermark before it."""
    seen, newest, out = set(), None, []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        for r in rows[a:b]:
            if r[0] not in seen and (newest is None or r[1] > newest - timedelta(minutes=10)):
                seen.add(r[0])
                out.append(r)
        newest = max([r[1] for r in rows[a:b]] + ([newest] if newest else []))
    return [r for r in out if r[0] != 999]


def test_windows(spark, tmp_path, events):
    rows, cuts = events
    got = fed(spark, tmp_path, rows, cuts, EVENT, lambda s: ordered.window_stream(s, f"{tmp_path}/out", f"{tmp_path}/check"))
    want = {}
    for _, ts, _, kind in counted(rows, cuts):
        k = (ts.replace(minute=0, second=0), kind)
        want[k] = want.get(k, 0) + 1
    assert {(r.start, r.event_type): r.n for r in got.collect()} == want and not any(k[1] == "late" for k in want)


def test_sessions(spark, tmp_path, events):
    rows, cuts = events
    got = fed(spark, tmp_path, rows, cuts, EVENT, lambda s: ordered.session_stream(s, f"{tmp_path}/out", f"{tmp_path}/check", gap="7 minutes"))
    want = []
    for user in range(3):
        times = sorted(ts for _, ts, u, _ in counted(rows, cuts) if u == user)
        begin = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] >= timedelta(minutes=7):
                want.append((user, times[begin], times[i - 1] + timedelta(minutes=7), i - begin))
                begin = i
    assert sorted(map(tuple, got.collect())) == sorted(want)
