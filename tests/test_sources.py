import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnfield import schemas
from cairnfield.sources import files, web
from cairnfield.streaming import alerts

PAGE = """<div id="content-core"><div class="item"><h2 class="headline">Lista  de
protocolos</h2><table><tr><td>1</td><td><a href="/p#q">Um <b>dois</b></a> desc aqui</td></tr><tr><td>2</td><td>none</td></tr>
<tr><td>3</td><td><a href="/p">Again</a></td></tr><tr><td>4</td><td><a href="x/y.pdf">Tres</a></td></tr></table></div></div>"""


def test_links(spark):
    hrefs = ["#a", "javascript:x", "mailto:y", "ftp://h/f", "/p#q", "q.html", "../r", "//o/s", "https://z/", ""]
    df = spark.createDataFrame([(i, "http://h/d/e", h) for i, h in enumerate(hrefs)], "i int, b string, h string")
    got = [r[1] for r in sorted(df.select("i", web.resolve(F.col("b"), F.col("h"))).collect())]
    assert got == [None, None, None, None, "http://h/p", "http://h/d/q.html", "http://h/r", "http://o/s", "https://z/", None]


def test_table_links(spark):
    df = spark.createDataFrame([(1, "http://h/d/", PAGE), (2, "http://h/", "<p>x</p>"), (3, None, None)], "page_id long, url string, html string")
    got = web.table_links(df, "Lista de protocolos").collect()
    assert [(r.page_id, r.title, r.link, r.description, r.error) for r in sorted(got, key=lambda r: (r.page_id, r.ordinal or 0))] == [
        (1, "Um dois", "http://h/p", "desc aqui", None),
        (1, "Tres", "http://h/d/x/y.pdf", "", None),
        (2, None, None, None, "heading not found"),
        (3, None, None, None, "heading not found"),
    ]


def test_events_fold(spark):
    body = 'event: sources\r\ndata: ["s"]\r\n\r\nevent: token\r\ndata: "a"\r\n\r\nevent: token\r\ndata: "b"\r\n\r\nevent: done\r\ndata: {}\r\n\r\n'
    events = web.parse_sse(spark.createDataFrame([(1, body), (2, body + "event: error\ndata: x\n\n")], "k int, body string"), "k", "body")
    told = events.withColumn("text", F.from_json(F.concat(F.lit('{"v":'), "data", F.lit("}")), "v string")["v"])
    assert sorted(map(tuple, web.fold_events(told, "k", "seq", "event", "text").collect())) == [(1, "ab", 2, False), (2, "ab", 2, True)]


def test_manifests(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"source_stem": "a", "chunk_count": 2, "status": "ok"}\n\n   \n{"source_stem": "b", "status": "error"}\n')
    assert files.read_manifest(spark, str(p), schemas.CHUNK_INDEX).select("source_stem", "chunk_count").collect() == [("a", 2), ("b", None)]
    assert files.read_manifest(spark, str(tmp_path / "none.jsonl"), schemas.CHUNK_INDEX).count() == 0
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_manifest(spark, str(p), schemas.CHUNK_INDEX).collect()
    out = str(tmp_path / "out")
    for append in (False, True):
        files.write_manifest(spark.createDataFrame([("ã",)], "source_stem string"), out, append)
    assert files.read_manifest(spark, out, "source_stem string").count() == 2


def test_pages_and_chunks(spark, tmp_path):
    (tmp_path / "doc.pages.jsonl").write_text('{"page": 2, "markdown": "b"}\n{"page": 1}\n')
    assert sorted(map(tuple, files.read_pages(spark, str(tmp_path / "doc.pages.jsonl")).collect())) == [("doc", 1, ""), ("doc", 2, "b")]
    rows = [{"text": t, "metadata": {"source_stem": "doc1", "source_pdf": "d", "chunk_index": i, "page_start": 1, "page_end": 1, "page_range": [1, 1]}} for i, t in enumerate("xy")]
    (tmp_path / "c.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    assert [r.id for r in files.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == ["doc1:0", "doc1:1"]
    (tmp_path / "c.jsonl").write_text('{"text": "x", "metadata": {"chunk_index": 0}}')
    with pytest.raises(Exception):
        files.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()


def test_zip_catalog(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "1|2")
        z.writestr("d/", "")
    got = files.zip_catalog(spark, str(tmp_path)).collect()
    assert [(r.archive, r.relative_path, r.bytes) for r in got][1:] == [("a.zip", "d/x.csv", 3)] and len(got) == 2
    assert files.list_files(spark, str(tmp_path), "*.zip").select("name").first()[0] == "a.zip"


def test_exam_results(spark, tmp_path):
    (tmp_path / "e.csv").write_text("ID_PACIENTE|IC_SEXO|AA_NASCIMENTO|CD_UF|DT_COLETA|DE_ORIGEM|DE_EXAME|DE_ANALITO|DE_RESULTADO|CD_UNIDADE|DE_VALOR_REFERENCIA\nP|F|AAAA|SP|03/04/2020|x|y|z|80|mg|75 a 99\n")
    r = files.read_exam_results(spark, str(tmp_path / "e.csv")).first()
    assert (r.birth_year, str(r.collected_on), r.reference_low, r.reference_high) == (None, "2020-04-03", 75.0, 99.0)


def test_run_summary(spark):
    df = spark.createDataFrame([("1", "ok", None), ("2", "error", "boom"), ("3", "skipped", "dup")], "id string, status string, detail string")
    r = files.run_summary(df, "1", "u", "a", "b").first()
    assert (r.links_discovered, r.counts.ok, r.counts.skipped, r.counts.error, r.errors) == (3, 1, 1, 1, ["boom"])


PATCH = "patient_id string, recorded_at int, oxygen_saturation int, temperature double, heart_rate int, blood_pressure string"


def test_alert_stream_is_exactly_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for i, spo2 in enumerate((80, 95, 70)):
        spark.createDataFrame([("p", i, spo2, None, None, None)], PATCH).coalesce(1).write.mode("append").parquet(src)
        alerts.alert_stream(alerts.read_patches(spark, src, PATCH), out, cp).awaitTermination(60)
    assert sorted(r.recorded_at for r in spark.read.parquet(out).collect()) == [0, 2]


def test_upsert_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for v in (1, 2):
        spark.createDataFrame([("a", v), (f"k{v}", v)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
        alerts.upsert_stream(spark.readStream.schema("k string, v int").parquet(src), "k", out, cp).awaitTermination(60)
    assert sorted(map(tuple, alerts.read_upserted(spark, out, spark.read.parquet(src).schema).collect())) == [("a", 2), ("k1", 1), ("k2", 2)]
