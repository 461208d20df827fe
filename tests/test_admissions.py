from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import admissions, catalogs, chunking, incremental, records, windows
from cairnfield.plans import reference_data
from cairnfield.sources import files
from cairnfield.storage import shared_dir
from cairnfield.streaming import alerts


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_last_given_carries_over_ranges_and_null_keys(spark):
    data = [(k, i, i if i % 5 == 0 else None) for k in ("a", None) for i in range(40)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    for with_row in (True, False):
        got = {(r.k, r.i): r.o for r in windows.last_given(df, "k", ["i"], {"o": F.col("v")}, with_row, width=7).collect()}
        want = {(k, i): max((j for j in range(i + with_row) if j % 5 == 0), default=None) for k, i, _ in data}
        assert got == want


def test_several_running_sums_at_once(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "i int")
    got = windows.running_sums(df, [], "i", {"a": F.col("i"), "b": F.lit(1)}, width=4).collect()
    assert all(r.a == sum(range(r.i)) and r.b == r.i for r in got) and len(got) == 30


def test_splitter_parameters():
    pieces = lambda t, **k: [t[a:b] for a, b in chunking.recursive_pieces(t, **k)]
    assert pieces("aaa bbb ccc ddd", size=7, overlap=0) == ["aaa bbb", "ccc", "ddd"]
    assert pieces("aaa bbb ccc", size=8, overlap=4) == ["aaa bbb", "bbb ccc"]
    assert pieces("one\n\ntwo. three", size=8, overlap=0) == ["one", "two", ". three"]
    assert pieces("abcdefgh", size=3, overlap=1) == ["abc", "cde", "efg", "gh"]
    assert pieces("a|b|c", size=3, overlap=0, separators=("|", "")) == ["a|b", "|c"] and pieces("  \n", size=4, overlap=1) == []
    assert [(a, b) for a, b, _, _ in chunking.header_sections("# A\nx\n#### B\ny\n## no\n# C\nz", levels=(1, 4))] == [("A", None), ("A", "B"), ("C", None)]


def test_listings_are_sorted(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, None)], "id int, at int")
    assert [r.id for r in records.newest_first(df, "at", "id").collect()] == [2, 1, 3, 4]
    assert [r.id for r in records.newest_first(df, "at", "id", key_descends=True).collect()] == [2, 3, 1, 4]


def test_first_rows_with_negative_numbers(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "i int")
    first = lambda n, **k: [r.i for r in incremental.first_rows(df, n, "i", **k).collect()]
    assert (first(2), first(None), first(-2), first(-2, from_end=True), first(-9, from_end=True)) == ([0, 1], [0, 1, 2, 3, 4], [], [0, 1, 2], [])


def test_seed_only_if_empty(spark):
    some, none = spark.createDataFrame([(1,)], "i int"), spark.createDataFrame([], "i int")
    assert rows(incremental.seed_if_empty(none, some)) == [(1,)] and rows(incremental.seed_if_empty(some.limit(1), none)) == [(1,)]


def test_full_record_of_a_patient_without_children(spark):
    patients = spark.createDataFrame([(1, "Ana", "A41.9", "Sepse")], "id long, name string, cid_code string, cid_label string")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    got = admissions.full_record(patients, empty("id long, patient_id long, at_us long"), empty("id long, exam_id long, name string, mime string, size long, path string"), empty("id long, patient_id long"), empty("id long, patient_id long, at_us long"), empty("id long, patient_id long, at_us long, heart_rate int, recorded_at string")).first()
    assert got.body == '{"id":1,"name":"Ana","cid":{"code":"A41.9","label":"Sepse"},"vitalSigns":{"heartRate":72,"updatedAt":null},"exams":[],"suggestedItems":[],"agentLog":[]}'


def test_repeating_a_change_gives_the_same_rows(spark):
    patients = spark.createDataFrame([(7, "L40.5"), (8, "??"), (9, None)], "id long, cid_code string")
    first, second = (admissions.protocol_children(patients, reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL, "admission", "t") for _ in "ab")
    assert [rows(a) for a in first] == [rows(b) for b in second]
    exams = first[0].groupBy("patient_id").count().collect()
    assert {r.patient_id: r["count"] for r in exams} == {7: 5, 8: 2, 9: 2} and first[0].select("id").distinct().count() == 9


def test_codes_change_only_where_they_differ(spark):
    patients = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "id long, cid_code string, cid_label string")
    asked = spark.createDataFrame([(1, "a", "other"), (2, "c", "C"), (3, "d", "D")], patients.schema)
    moved = admissions.code_changes(patients, asked)
    assert rows(moved) == [(2, "c", "C")] and rows(admissions.changed(patients, moved)) == [(1, "a", "A"), (2, "c", "C")]


def test_toggle_and_labels(spark):
    df = spark.createDataFrame([(["a", "b"], "b"), (["a"], "c"), ([], "c")], "s array<string>, i string")
    assert [r[0] for r in df.select(catalogs.toggle(F.col("s"), F.col("i"))).collect()] == [["a"], ["a", "c"], ["c"]]


def test_codes_with_many_suffixes(spark):
    labels = spark.createDataFrame([(i, n) for i, n in enumerate(["x", "x 2", "x", "x", "x 2"])], "ordinal long, label string")
    used = spark.createDataFrame([("X_3",)], "code string")
    assert [r[2] for r in rows(catalogs.unique_codes(labels, used))] == ["X", "X_2", "X_4", "X_5", "X_2_2"]


def test_pages_and_chunks_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("a b", 2, "two"), ("a b", 1, "one"), ("c", 1, "")], "stem string, page int, markdown string")
    files.write_pages(pages, f"{tmp_path}/pages")
    assert rows(files.read_pages(spark, f"{tmp_path}/pages/*")) == rows(pages)
    chunks = spark.createDataFrame([("t", ("s", 3))], "text string, metadata struct<source_stem: string, chunk_index: int>")
    files.write_chunks(chunks, f"{tmp_path}/chunks")
    assert rows(files.read_chunks(spark, f"{tmp_path}/chunks"), "id", "text") == [("s:3", "t")]


@pytest.mark.parametrize("n", [3, 25])
def test_errors_beyond_twenty_end_in_dots(spark, n):
    df = spark.createDataFrame([(f"{i:02}", "error", f"e{i}") for i in range(n)] + [("z", "ok", None)], "id string, status string, detail string")
    got = files.run_summary(df, "1", "u", "a", "b").first()
    assert got.errors == [f"e{i}" for i in range(min(n, 20))] + ["..."] * (n > 20) and got.counts.error == n


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    source, table = tmp_path / "in", f"{tmp_path}/table"
    schema = "k long, v string"
    for number, data in enumerate([[(i, "a") for i in range(50)], [(3, "b"), (70, "b")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
        alerts.upsert_stream(alerts.read_patches(spark, str(source), schema), "k", table, f"{tmp_path}/check").awaitTermination()
    kept = spark.createDataFrame([], schema).schema
    got = {r.k: r.v for r in alerts.read_upserted(spark, table, kept).collect()}
    assert got == {i: "a" for i in range(50)} | {3: "b", 70: "b"}
    assert rows(alerts.read_upserted(spark, table, kept, before=1), "k") == sorted([(i,) for i in range(50)], key=str)
    assert spark.read.parquet(f"{table}/upsert_batch=1").select("upsert_bucket").distinct().count() <= 2


def test_the_shared_folder_is_one_that_executors_see():
    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))
    assert shared_dir(SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"
