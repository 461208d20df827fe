from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.operators import catalogs, chunking, incremental, records, rules, windows
from cairnfield.plans import reference_data


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


# Chunking.


def test_spans_stitch_and_ranges(spark):
    pages = spark.createDataFrame([("d", 1, "ab"), ("d", 2, "cde"), ("e", 5, None), ("d", 3, "")], "stem string, page int, text string")
    spans = chunking.page_spans(pages, "stem", "page", "text")
    assert rows(spans) == [("d", 1, 0, 2), ("d", 2, 4, 7), ("d", 3, 9, 9), ("e", 5, 0, 0)]
    assert rows(chunking.stitch(pages, "stem", "page", "text")) == [("d", "ab\n\ncde\n")]
    assert rows(chunking.chunk_page_ranges(spans, size=4, overlap=1)) == [("d", 0, 1, 1), ("d", 1, 2, 2), ("d", 2, 2, 2)]


def test_a_chunk_that_touches_no_page(spark):
    spans = spark.createDataFrame([("d", 7, 0, 3), ("d", 9, 20, 22)], "stem string, page int, start long, end long")
    got = rows(chunking.chunk_page_ranges(spans, size=5, overlap=1))
    assert got[0] == ("d", 0, 7, 7) and got[2] == ("d", 2, 1, 1) and got[-1][2:] == (9, 9)


def test_header_sections():
    assert [(a, b, s.strip()) for a, b, _, s in chunking.header_sections("## A\nx\n### B\ny\n## C\nz")] == [("A", None, "x"), ("A", "B", "y"), ("C", None, "z")]
    assert chunking.header_sections("# T\nbody") == [(None, None, 0, "# T\nbody")] and chunking.header_sections(" \n") == []


@given(st.text(alphabet="ab. \n", max_size=300))
def test_recursive_pieces(t):
    pieces = chunking.recursive_pieces(t, size=40, overlap=8)
    covered = {i for a, b in pieces for i in range(a, b)}
    assert all(0 < b - a <= 40 for a, b in pieces) and all(i in covered for i, c in enumerate(t) if not c.isspace())
    assert [a for a, _ in pieces] == sorted({a for a, _ in pieces})


def test_section_chunks_have_exact_offsets(spark):
    body = "## One\n" + "word " * 500 + "\n### Two\n" + "other. " * 400
    got = chunking.section_chunks(spark.createDataFrame([("d", body), ("e", None), ("f", " ")], "s string, t string"), "s", "t").collect()
    assert {r.source_stem for r in got} == {"d"} and [r.chunk_index for r in got] == list(range(len(got)))
    assert all(body[r.start : r.end] == r.text for r in got) and {r.section for r in got} == {"One", "One > Two"}


# Records.


def test_the_four_filters(spark):
    df = spark.createDataFrame([("a", "x%y", "all"), ("b", "xzy", "doctors"), ("c", "Q", "nurses")], "s string, n string, team string")
    assert records.where_truthy(df, "s", "").count() == 3 and records.where_given(df, "s", "").count() == 0
    assert records.where_truthy(df, "s", "a").count() == records.where_given(df, "s", "a").count() == 1
    assert rows(records.matching(df, "X%Y", "n"), "s") == [("a",), ("b",)] and rows(records.holding(df, " x%Y ", "n"), "s") == [("a",)]
    assert rows(records.for_team(df, "doctors"), "s") == [("a",), ("b",)] and records.for_team(df, None).count() == 3


def test_carry_forward_and_latest(spark):
    df = spark.createDataFrame([("p", 1, 95, 80), ("p", 2, 90, None), ("q", 1, None, None)], "p string, at int, spo2 int, hr int")
    got = records.carry_forward(df, "p", ["at"], {"spo2": 97, "hr": 72})
    assert rows(windows.latest(got, "p", "at"), "p", "spo2", "hr") == [("p", 90, 80), ("q", 97, 72)]
    assert rows(records.fold_patches(df, "p", "at", ["spo2", "hr"])) == [("p", 90, 80), ("q", None, None)]


def test_nested_children(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, "b", 2), (1, "a", 9)], "id int, name string, at int")
    got = records.with_children(parents, "id", records.nested(kids, "id", "kids", F.col("at"))).collect()
    assert {r.id: [k.name for k in r.kids] for r in got} == {1: ["b", "a"], 2: []}


def test_fixed_groups(spark):
    items = spark.createDataFrame([("exam",), ("foo",), ("exam",)], "type string")
    assert rows(records.fixed_groups(items, "type", ["exam", "prescription", "observation", "review"])) == [(0, "exam", 2), (1, "prescription", 0), (2, "observation", 0), (3, "review", 0)]


def test_running_sum_over_ranges(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(50)], "k string, i int")
    got = {(r.k, r.i): r.s for r in windows.running_sum(df, ["k"], "i", F.col("i"), "s", width=4).collect()}
    assert all(got[k, i] == sum(j for j in range(i) if ("a" if j % 3 else None) == k) for k, i in got) and len(got) == 50


# Rules.

PATCH = "patient_id string, recorded_at int, oxygen_saturation int, temperature double, heart_rate int, blood_pressure string"


def test_vital_alert_edges(spark):
    cases = [(91, None, None, None, 1), (92, None, None, None, 0), (None, 34.9, None, None, 1), (None, 35.0, None, None, 0), (None, 38.9, None, None, 0), (None, 39.0, None, None, 1), (None, None, 44, None, 1), (None, None, 45, None, 0), (None, None, 120, None, 0), (None, None, 121, None, 1), (None, None, None, "179/80", 0), (None, None, None, "180/80", 1), (None, None, None, "19/11", 1), (None, None, None, "x", 0), (80, 40.0, 130, "200/1", 4), (None, None, None, None, 0)]
    df = spark.createDataFrame([(str(i), i, *c[:4]) for i, c in enumerate(cases)], PATCH)
    got = rules.vital_alerts(df).collect()
    assert [sum(r.recorded_at == i for r in got) for i in range(len(cases))] == [c[4] for c in cases]
    assert {r.message for r in got if r.recorded_at == 14} == {"SpO2 crítico registrado (80%).", "Temperatura crítica registrada (40.0 °C).", "Frequência cardíaca crítica registrada (130 bpm).", "Pressão arterial crítica registrada (200/1)."}


def test_transitions_fire_on_edges(spark):
    df = spark.createDataFrame([("e", 1, "pending"), ("e", 2, "critical"), ("e", 3, "critical"), ("f", 1, "critical")], "id string, at int, status string")
    assert rows(rules.transitions(df, "id", ["at"], "status", "critical"), "id", "at") == [("e", 2), ("f", 1)]


def test_pending_exams(spark):
    exams = [("a", i, n, "pending") for i, n in enumerate(["X", "Y", "Lactato sérico", "Z"])] + [("b", 1, "X", "pending"), ("b", 2, "Y", "pending"), ("c", 1, "PCR", "done")]
    df = spark.createDataFrame(exams, "p string, o int, n string, s string")
    got = rules.pending_alerts(df, "p", F.col("n"), F.col("s"), "o").collect()
    assert sorted((r.patient, r.severity) for r in got) == [("a", "critical"), ("a", "critical"), ("b", "moderate")]
    assert any(r.message == "Exames aguardando revisão: X, Y." for r in got)


def test_decision_flow(spark):
    one = [("1", "A41.9", "Ana", 62, "P", False, ["Lactato sérico"], 4), ("2", "T81.4", "Rui", 50, "P", True, [], 0)]
    df = spark.createDataFrame(one, "id string, code string, name string, age int, protocol string, interaction boolean, exam_names array<string>, n_items int")
    got = rules.flow_lines(df, "2024-01-01 10:00:00").collect()
    first = [r.line for r in sorted((r for r in got if r.id == "1"), key=lambda r: r.line_no)]
    assert first[2] == "[10:00:02] Exames identificados: Lactato" and first[-1] == "[10:00:05] Fluxo concluido" and len(first) == 7
    assert any("nenhum" in r.line for r in got if r.id == "2") and all(r.pharmacy_interaction == (r.id == "2") and r.sepsis_critical == (r.id == "1") for r in got)


# Catalogs.


def test_codes(spark):
    labels = spark.createDataFrame(list(enumerate(["a + b", "5-FU", "***", "A + B", "taken", "x", "x 2", "X", "x"])), "ordinal int, label string")
    used = spark.createDataFrame([("TAKEN",), ("TAKEN_2",)], "code string")
    assert [r[2] for r in sorted(map(tuple, catalogs.unique_codes(labels, used).collect()))] == ["A_MAIS_B", "MED_5_FU", "MEDICAMENTO", "A_MAIS_B_2", "TAKEN_3", "X", "X_2", "X_3", "X_4"]


def test_merge(spark):
    catalog = spark.createDataFrame([(0, "X", "Varfarina", "Varfarina sodica", ["a"])], "ordinal int, code string, label string, active_ingredient string, source_tags array<string>")
    names = spark.createDataFrame(list(enumerate(["VARFARINA SODICA", "Novo", "novo", "varfarina", "*"])), "ordinal int, name string")
    got = {r.code: r for r in catalogs.merge(catalog, names).collect()}
    assert got["X"].source_tags == ["a", "RENAME-2024"] and got["NOVO"].label == "Novo" and len(got) == 2


def test_extract(spark):
    head = ["Denominação Comum Brasileira", "Concentração", "Forma  farmacêutica", "Código ATC"]
    cells = [(1, 0, head), (1, 1, ["ácido*", "1", "c", " a10ba02 "]), (1, 2, ["x", "1", "c", "A1"]), (1, 3, ["y", "1", "c", None]), (1, 4, ["Acido", "2", "c", "A10BA02"]), (1, 5, ["short"]), (2, 0, head[:3]), (2, 1, ["z", "1", "c"])]
    df = spark.createDataFrame(cells, "table_id int, row_no int, cells array<string>")
    assert [r.name for r in catalogs.extract(df).collect()] == ["Acido"]


def test_lookups(spark):
    df = spark.createDataFrame([("L40.5",), ("L40.9",), ("A41.0",), ("Z00",)], "code string")
    got = {r.code: r.answer.split("|") for r in catalogs.prioritised(df, "code", reference_data.quick_questions(spark), reference_data.QUICK_PREFIXES, "default").collect()}
    q = reference_data.QUICK_QUESTIONS
    assert got == {"L40.5": q["L40.5"], "L40.9": q["L40.5"], "A41.0": q["A41.9"], "Z00": q["default"]}
    told = {r.code: r for r in catalogs.apply_protocols(df.union(spark.createDataFrame([("T81.4",)], "code string")), "code", reference_data.protocols(spark), reference_data.DEFAULT_PROTOCOL).collect()}
    assert told["T81.4"].interaction and not told["Z00"].interaction and told["Z00"].protocol_ref.startswith("Protocolo institucional")
    assert reference_data.comorbidities(spark).count() == 22 == reference_data.diagnoses(spark).count()


# Manifests.


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2")], "id int, c string")
    assert rows(incremental.exact_duplicates(df, "id", F.col("c")), "id", "status", "detail") == [(1, "ok", None), (2, "skipped", "duplicate_sha256"), (3, "ok", None)]


def test_unchanged(spark):
    df = spark.createDataFrame([("100", 100.0), ("100", 200.0), (None, 100.0), ("bad", 1.0)], "a string, b double")
    assert [r[0] for r in df.select(incremental.unchanged(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_upsert_replaces_whole_rows(spark):
    schema = "k string, ord int, n int, error string"
    old, new = spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 2, None)], schema), spark.createDataFrame([("a", 0, 3, None), ("c", 0, 4, None)], schema)
    got = incremental.upsert(old, new, "k", "ord")
    assert rows(got) == [("a", 3, None), ("b", 2, None), ("c", 4, None)]
    assert rows(incremental.replace_by_key(incremental.replace_by_key(old, new, "k"), new, "k")) == rows(incremental.replace_by_key(old, new, "k"))


def test_candidates_and_scans(spark):
    schema = "chunks_jsonl_relative_path string, status string"
    m = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "error"), ("", "skipped"), (None, "ok")], schema)
    files = spark.createDataFrame([("a",), ("c",), ("",)], "path string")
    assert rows(incremental.embed_candidates(m, files), "chunks_jsonl_relative_path") == [("a",)]
    inputs = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "id int, mtime double")
    made = spark.createDataFrame([(1, 5.0), (2, 4.0)], "id int, mtime double")
    assert rows(incremental.stale(inputs, made, "id"), "id") == [(2,), (3,)]


def test_counters(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "error"), (3, "ok")], "i int, status string")
    assert rows(incremental.run_counters(df, "i", "status", ("ok", "error")), "i", "n_ok", "n_error") == [(1, 1, 0), (2, 1, 1), (3, 2, 1)]
    assert rows(incremental.status_counts(df, "status", ("ok", "skipped"))) == [("ok", 2), ("skipped", 0)]
