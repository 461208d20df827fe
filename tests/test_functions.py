import duckdb
import pytest
from pyspark.sql import functions as F

from cairnfield.functions import clinical, text
from cairnfield.plans.oracles import SQL


def values(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.clean_markdown, ["A\n 12 \nB\n12345\n", "7\r\n", "x 1 y", ""], ["A\nB\n12345\n", "", "x\ny\n", ""]),
        (text.norm_space, ["  a\t\n b ", ""], ["a b", ""]),
        (text.ascii_fold, ["Ácido", "ﬁn ½", None], ["Acido", "fin 1⁄2", None]),
        (text.norm_key, ["Ácido  Fólico – 5mg", "A + B"], ["acido folico 5mg", "a + b"]),
        (text.sanitize_name, ["•ácido fólico**", "", "a – b"], ["Acido folico", "", "A - b"]),
        (text.code_base, ["a + b", "5-FU", "***"], ["A_MAIS_B", "MED_5_FU", "MEDICAMENTO"]),
        (text.parse_lines, [" a \n\n b", "", None], [["a", "b"], [], []]),
        (text.word_count, [" a  b\nc ", "", None], [3, 0, 0]),
        (text.html_escape, ["<a href=\"x\">'&'</a>"], ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"]),
        (clinical.systolic, ["120/80", "19/11", " 30 /x", "31", "", None, "abc", "12.5"], [120, 190, 300, 31, None, None, None, None]),
        (clinical.selectable_code, ["A00", "A00.1", "I", "A00-A09", "A0", "1A0", None, "É12"], [True, True, False, False, False, False, False, True]),
        (lambda c: text.non_blank(c, "?"), [" x ", "", None], ["x", "?", "?"]),
    ],
)
def test_strings(spark, f, given, want):
    assert values(spark, given, "string", f) == want


def test_first_letters_as_in_sql(spark):
    rows = ["ßheit ß", "• ßa", "ß", "straße", "éa", "", None]
    sql = SQL["sanitize_name"].replace("sha256", "").replace("FROM documents", "FROM (SELECT unnest(range(len(?))) AS doc_id, unnest(?) AS text)")
    want = [r[1] for r in sorted(duckdb.execute(sql, [rows, rows]).fetchall())]
    assert values(spark, rows, "string", text.sanitize_name) == want


def test_ages(spark):
    assert values(spark, [None, -5, 60, 300], "int", clinical.clamp_age) == [45, 0, 60, 120]


@pytest.mark.parametrize("url, kind, want", [("http://h/a b.pdf", "application/pdf", "a_b.pdf"), ("http://h/doc", "application/pdf", "doc.pdf"), ("http://h/", "text/html", "document.html"), ("http://h/x", None, "x.bin"), ("http://h/p/n.v/?q=a/b", "text/html", "n.v")])
def test_file_names(spark, url, kind, want):
    df = spark.createDataFrame([(url, kind)], "u string, k string")
    assert df.select(text.local_filename(F.col("u"), F.col("k"))).first()[0] == want


@pytest.mark.parametrize(
    "kind, given, want",
    [
        ("oxygen_saturation", [89, 90, 93, 94], ["crit", "warn", "warn", "normal"]),
        ("temperature", [38, 39], ["warn", "crit"]),
        ("heart_rate", [100, 101, 121], ["normal", "warn", "crit"]),
        ("systolic", [139, 140, 180], ["normal", "warn", "crit"]),
    ],
)
def test_tiers(spark, kind, given, want):
    assert values(spark, [float(v) for v in given], "double", lambda c: clinical.vital_tier(F.lit(kind), c)) == want


def test_breadcrumbs_and_citations(spark):
    df = spark.createDataFrame([("X", "Y"), (None, "Y"), (" ", None)], "a string, b string")
    assert [r[0] for r in df.select(clinical.breadcrumb(F.col("a"), F.col("b"))).collect()] == ["X > Y", "Y", "(sem cabeçalho)"]
    cite = spark.range(1).select(clinical.citation(F.lit("s"), F.lit(1), F.lit(None))).first()[0]
    assert cite == "PCDT s (pp. 1-?)"
