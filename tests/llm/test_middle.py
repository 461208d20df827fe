"""Fill-in-middle: against a plain computation, round trips, odd inputs."""

import hashlib
import re

from pyspark.sql import functions as F

from cairnfield.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plainly(doc_id, text):
    """The row that the digest query gives."""
    text = text or ""
    units, h = UNIT.findall(text), sha(f"42:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


ODD = [
    "", " ", "\n\t ", "one", " one", "one ", "a  b\x0b\x0cc\r\n d ", "x<P>y", "<S>", "<<P", "<S", "a <", "P> b", " no break ", "𝔘𝔫𝔦 ćode 🎉 \U0010ffff end", "$1 \\ $2", "{3}+ (?:a)", "\x00 nul \x1f",
]


def test_rows(spark):
    rows = [(i * 1000 + k, t) for i, t in enumerate([*ODD, None]) for k in range(40)] + [(None, "null id here"), (-5, "negative id a b"), (2**62, "large id a b c"), (7, "again a b"), (7, "again a b")]
    got = middle.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plainly(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts(spark):
    """Hundreds of thousands of units, and white space without an end, fit a task's stack."""
    long = ["ab cd\n" * 150_000, " " * 1_000_000 + "x", "y" + "\t" * 1_000_000, "z" * 3_000_000]
    rows = [(i * 10 + k, t) for i, t in enumerate(long) for k in range(4)]
    got = middle.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plainly(*r)) for r in rows)


def test_transform_keeps_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} x y z", f"_{i}", i) for i in range(60)], "doc_id long, text string, _a string, n long")
    told = middle.transform(docs, seed=7, percent=100, spm_percent=50)
    assert told.columns == ["doc_id", "text", "_a", "n", "fim_n", "fim_form", "fim_output"]
    back = told.select("text", "_a", "n", "doc_id", "fim_form", middle.restore(F.col("fim_output"), F.col("fim_form")).alias("back")).collect()
    assert all(r.back == r.text and r["_a"] == f"_{r.doc_id}" and r.n == r.doc_id for r in back)
    assert {r.fim_form for r in back} == {"psm", "spm"}


def test_no_python_worker_and_one_match(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = middle.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowToRow", "")


def test_empty_table(spark):
    assert middle.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
