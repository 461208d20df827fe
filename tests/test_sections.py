"""Sections under headers, code fences, recursive chunks with page ranges."""

import hashlib
import random

import pytest

from cairnfield.operators import chunking


def parts(markdown):
    return [(h1, h2, body.strip()) for h1, h2, _, body in chunking.header_sections(markdown)]


@pytest.mark.parametrize("markdown, want", [
    ("## A\n```\n## not a header\n```\nx", [("A", None, "```\n## not a header\n```\nx")]),
    ("## A\n~~~ python\n### no\n```\n## no\n~~~\n### B\ny", [("A", None, "~~~ python\n### no\n```\n## no\n~~~"), ("A", "B", "y")]),
    ("```\n~~~\n## no\n```\n## A\nz", [(None, None, "```\n~~~\n## no\n```"), ("A", None, "z")]),
    ("## A\n```code``` in a line\n## B\nx", [("A", None, "```code``` in a line"), ("B", None, "x")]),
    ("  ## A  \nx\n##B\n#### C\n###\ty", [("A", None, "x\n##B\n#### C\n###\ty")]),
    ("## A\n### B\n## C\nx", [("C", None, "x")]),
    ("##\nx\n### B\ny", [("", None, "x"), ("", "B", "y")]),
    ("## A\n```\nopen to the end\n## no", [("A", None, "```\nopen to the end\n## no")]),
    ("## A​\nx", [("A", None, "x")]),
    ("", []), ("\n \n", []), ("## A", []),
])
def test_header_sections(markdown, want):
    assert parts(markdown) == want
    for _, _, at, body in chunking.header_sections(markdown):
        assert markdown[at : at + len(body)] == body


def test_sections_rows(spark):
    docs = spark.createDataFrame([("a", "intro\n## One\nx y\n### Two\nz\n## Three\nlast"), ("b", "# Title\nbody"), ("c", None), ("d", "")], "stem string, text string")
    got = sorted(map(tuple, chunking.sections(docs, "stem", "text").select("source_stem", "section", "start", "end", "text").collect()))
    assert got == [("a", "(sem cabeçalho)", 0, 6, "intro\n"), ("a", "One", 13, 17, "x y\n"), ("a", "One > Two", 25, 27, "z\n"), ("a", "Three", 36, 40, "last"), ("b", "(sem cabeçalho)", 0, 12, "# Title\nbody")]
    chunks = sorted(map(tuple, chunking.section_chunks(docs, "stem", "text").select("source_stem", "section", "chunk_index", "start", "end", "text").collect()))
    assert chunks == [("a", "(sem cabeçalho)", 0, 0, 5, "intro"), ("a", "One", 1, 13, 16, "x y"), ("a", "One > Two", 2, 25, 26, "z"), ("a", "Three", 3, 36, 40, "last"), ("b", "(sem cabeçalho)", 0, 0, 12, "# Title\nbody")]


@pytest.mark.parametrize("width", [1 << 20, 150])
def test_page_chunks(spark, width):
    """Every piece lies in the stitched text at its offsets, and its pages are those a look at every page finds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    pages = []
    for stem, n in (("a", 60), ("b", 4), ("c", 1), ("d", 2)):
        for page in range(1, n + 1):
            text = rng.choice(["", "\n"]) if rng.random() < 0.2 else " ".join(rng.choice([word(), word(), "\n", ". ", "\n## " + word() + "\n", "\n\n"]) for _ in range(rng.randrange(80)))
            pages.append((stem, page, None if stem == "d" else text, 7))
    got = chunking.page_chunks(spark.createDataFrame(pages, "doc string, page int, markdown string, start int").repartition(3), "doc", "page", "markdown", size=120, overlap=20, width=width).collect()
    whole, spans = {}, {}
    for stem, page, text, _ in pages:
        at = len(whole[stem]) + 2 if stem in whole else 0
        whole[stem] = (whole[stem] + "\n\n" if stem in whole else "") + (text or "")
        spans.setdefault(stem, []).append((page, at, at + len(text or "")))
    want = sum(len(chunking.recursive_pieces(body, 120, 20)) for t in whole.values() for *_, body in chunking.header_sections(t))
    assert len(got) == want > 100 and len({r.chunk_id for r in got}) == want
    for r in got:
        assert whole[r.source_stem][r.start : r.end] == r.text and r.chunk_id == f"{r.source_stem}:{r.chunk_index}"
        met = [p for p, a, b in spans[r.source_stem] if r.start < b and r.end > a]
        assert (r.page_start, r.page_end) == ((min(met), max(met)) if met else (1, 1))


def test_recursive_chunks_query(spark, sf_dir):
    """The query's chunks against the documents' own texts."""
    from cairnfield.plans import catalogue

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalogue.QUERIES["recursive_chunks"](spark, sf_dir).collect()
    whole = {}
    for i, t in texts.items():
        pages = [t[a : a + 3000] for a in range(0, len(t), 3000)]
        whole[str(i)] = "\n\n".join((f"## Part {k // 4}\n" if k % 4 == 0 else "") + p for k, p in enumerate(pages))
    assert {r.source_stem for r in got} == {i for i, t in whole.items() if t.strip()}
    for r in got:
        assert hashlib.sha256(whole[r.source_stem][r.char_start : r.char_end].encode()).hexdigest() == r.piece
        assert r.page_start <= r.page_end and r.section.startswith("Part ")


def test_empty(spark):
    pages = spark.createDataFrame([], "doc string, page int, markdown string")
    assert chunking.page_chunks(pages, "doc", "page", "markdown").count() == 0
