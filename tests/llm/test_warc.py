import base64
import hashlib

import duckdb
import pandas as pd
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import warc

ROWS = [
    (1, "http://a.example.com/x", "same"),
    (2, "http://a.example.com/y", "same"),
    (3, "https://User@B.example.com:8080/Z?q=1#f", "line\r\n\r\nWARC/1.1\r\nWARC-Run-ID: x\r\n\r\nend\r\n\r\n"),
    (4, None, None),
    (5, "not a url", ""),
    (6, "http://a.example.com/x", "é" * 3000),
    (None, "http://c.example.com/", "same"),
    (None, "http://c.example.com/", "alone"),
    (7, "http://a.example.com/evil\r\nWARC-Type: x", "same"),
    (8, "http://d.example.com/", "\r\n\r\n"),
]


def index(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash")).repartition(3)
    path, run = warc.write_archives(df)
    return warc.read_archives(spark, path, run), path


def test_round_trip_and_revisits(spark):
    records, path = index(spark, ROWS)
    got = {(r.page_id, r.payload_digest): r for r in records.collect()}
    assert len(got) == len(ROWS)
    keep = {}
    for i, _, h in ROWS:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    for i, _, h in ROWS:
        raw = (h or "").encode()
        r = got[i, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        revisit = (-1 if i is None else i) < keep[h or ""]
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", keep[h or ""]) if revisit else ("response", None)) + (len(raw),)
        assert bytes(r.payload) == (b"" if revisit else raw)


def test_small_splits_read_the_same(spark):
    rows = [(i, f"http://h{i % 7}.example.com/{i}", f"page {i} " * (i % 90)) for i in range(400)]
    records, path = index(spark, rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert {(r.page_id, bytes(r.payload).decode()) for r in records.filter("record_type = 'response' and payload_bytes > 0").collect()} == {(i, h) for i, _, h in rows if h}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_histories_against_sql(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "KEY_ROWS", 4)
    monkeypatch.setattr(warc, "SEGMENT_ROWS", 16)
    rows = [(i, f"http://h{i % 3}.example.com/{i % 5}", f"body {i % 40}") for i in range(500)]
    got = warc.capture_histories(index(spark, rows)[0]).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = con.sql(warc.SQL).df()
    cols = list(want.columns)
    key = lambda d: sorted(map(str, d[cols].astype({"refers_to": "Int64"}).itertuples(index=False)))
    assert key(got) == key(want)
    assert sorted(got["history_pos"]) == list(range(500))


def test_empty_table(spark):
    assert warc.capture_histories(index(spark, [])[0]).count() == 0


@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.one_of(st.none(), st.integers(0, 9))), max_size=8), max_size=9))
def test_loser_tree_is_a_sort(runs):
    as_rows = lambda ts: sorted(({"url_key": u, "capture_time": t, "page_id": p} for u, t, p in ts), key=warc.capture_key)
    runs = [as_rows(r) for r in runs]
    got = list(warc.LoserTree(map(iter, runs)))
    assert [warc.capture_key(c) for c in got] == sorted(warc.capture_key(c) for r in runs for c in r)


def test_a_hot_url_over_several_ranges(spark, monkeypatch):
    """One URL holds most captures: its ranges are cut at whole keys and the order stays global."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    monkeypatch.setattr(warc, "KEY_ROWS", 4)
    rows = [(i, "http://hot.example.com/" if i % 8 else f"http://x{i % 5}.example.com/", f"b{i}") for i in range(600)]
    got = warc.capture_histories(index(spark, rows)[0]).collect()
    assert [r.history_pos for r in sorted(got, key=lambda r: (r.url_key, r.capture_time, r.page_id))] == list(range(600))


def test_revisits_name_their_profile(spark):
    path, _ = warc.write_archives(spark.createDataFrame([(1, "u", "a"), (2, "v", "a")], "page_id long, url string, html string"))
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert text.count(f"WARC-Profile: {warc.PROFILE}\r\n") == 1 == text.count("WARC-Type: revisit")


def test_any_long_is_a_page_id_in_any_time_zone(spark):
    ids = [2**62, 2**63 - 1, 2**40, -(2**63), -1, -2, 0, None, 5, 2**31, 2**31 + 5]
    rows = [(i, "http://one.example.com/", f"body {i}") for i in ids]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = warc.capture_histories(index(spark, rows)[0]).toPandas()
        dates = [r.d for r in spark.range(2).select(warc.capture_date(F.col("id")).alias("d")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert dates == ["2023-11-14T22:13:20Z", "2023-11-14T22:13:21Z"]
    assert all(len(t) == 14 and "2023" <= t[:4] <= "2092" for t in got["capture_time"])
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": pd.array(ids, dtype="Int64"), "url": [u for _, u, _ in rows], "html": [h for _, _, h in rows]}))
    want = dict(con.sql(f"SELECT payload_digest, history_pos FROM ({warc.SQL})").fetchall())
    assert dict(zip(got["payload_digest"], got["history_pos"])) == want
    order = sorted(ids, key=lambda i: ((i or 0) % 2**31, i is not None, i or 0))
    digest = lambda i: base64.b32encode(hashlib.sha1(f"body {i}".encode()).digest()).decode()
    assert [want[digest(i)] for i in order] == list(range(len(ids)))


def test_captures_alike_in_all_of_the_key_are_split(spark, monkeypatch):
    """One page a thousand times: no range holds more than a few times RANGE_ROWS of them."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "KEY_ROWS", 4)
    monkeypatch.setattr(warc, "SEGMENT_ROWS", 16)
    rows = [(None if i % 2 else 9, "http://hot.example.com/", f"b{i}") for i in range(1000)]
    records, seen, sums = index(spark, rows)[0], [], warc.running_sum
    monkeypatch.setattr(warc, "running_sum", lambda df, *a: seen.append(df.collect()) or sums(df, *a))
    got = warc.capture_histories(records).collect()
    assert sorted(r.history_pos for r in got) == list(range(1000))
    assert max(r["_n"] for r in seen[0]) <= 150 and len(seen[0]) >= 15
    assert all(r.page_id is None for r in got if r.history_pos < 500)
