"""Anchors of HTML and their resolution, against the standard library."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from cairnfield.sources import web
from cairnfield.sources.anchors import anchor_hrefs


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        href = next((v for k, v in attrs if k == "href"), None)
        if tag == "a" and any(k == "href" for k, _ in attrs):
            self.found.append((href or "").strip())


def plainly(text):
    p = Plain()
    p.feed(text)
    p.close()
    return p.found


@pytest.mark.parametrize("text, want", [
    ('<a href="/x?a=1&amp;b=2">', ["/x?a=1&b=2"]),
    ('<!-- <a href="/no"> --><a href="/1">', ["/1"]),
    ('<a data-href="/no" href="/2">', ["/2"]), ('<a data-href="/no">', []),
    ('<a href="http://h.org/8 ">', ["http://h.org/8"]),
    ('<A HREF="/3">', ["/3"]), ("<a href='/4'>", ["/4"]), ("<a href=/5>x</a>", ["/5"]), ('<a\nhref="/6">', ["/6"]), ("<a\n\tclass=x\n href = '/7' id>", ["/7"]),
    ('<script>var t = "<a href=\'/no\'>";</script><a href=/8>', ["/8"]), ("<style><a href=/no></style>", []), ("<title><a href=/no></TITLE ><a href=/9>", ["/9"]),
    ('<a title="a > b" href="/10">', ["/10"]), ("<a title='<a href=/no>' href=/11>", ["/11"]), ("<abbr href=/no><area href=/no>", []),
    ("<a href>x", [""]), ('<a href="">', [""]), ('<a href="/a" href="/b">', ["/a"]), ("<a/href=/12>", ["/12"]),
    ("<a href=/13/>", ["/13/"]), ('<a href="/&eacute;&#233;&#xE9;&copy=1&copy;">', ["/ééé&copy=1©"]), ('<a href="/q?x=1&copyx=2">', ["/q?x=1&copyx=2"]),
    ('<a href="/new\nline">', ["/newline"]), ("< a href=/no>", []), ("<a href=/14", []), ('<a href="/15', []), ("1 < 2 <a href=/16>", ["/16"]),
    ("<!doctype html><?x <a href=/no> ?><a href=/17>", ["/17"]), ("</a href=/no><a href=/18>", ["/18"]), ("<!--><a href=/19>", ["/19"]), ("<!-- a --!><a href=/20>", ["/20"]), ("", []),
])
def test_automaton(text, want):
    assert anchor_hrefs(text) == want


def test_against_the_standard_parser():
    """Random tags in all the forms that occur."""
    r = random.Random(12)
    quote = lambda v: r.choice([f'"{v}"', f"'{v}'", v])
    space = lambda: r.choice([" ", "\n", "  ", "\t"])
    for _ in range(600):
        parts = []
        for _ in range(r.randrange(12)):
            attributes = [f"{k}{r.choice(['=', ' = '])}{quote(r.choice(['/x', 'y.html', 'http://h/z', '/q?a=1&amp;b=2', '#f']))}" for k in r.sample(["href", "HREF", "data-href", "class", "id"], r.randrange(4))]
            tag = f"<{r.choice(['a', 'A', 'b', 'abbr'])}{''.join(space() + a for a in attributes)}{r.choice(['', space()])}>"
            parts.append(r.choice([tag, tag, tag, "text &amp; more", f"<!-- {tag} -->", f"<script>{tag}</script>", f"<style>{tag}</style>", "</a>", "</p >", "<br/>", "a < b"]))
        text = "".join(parts)
        assert anchor_hrefs(text) == plainly(text), text


def test_real_pages(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert anchor_hrefs(row.html or "") == plainly(row.html or "")


BASES = ["http://h.org", "http://h.org/", "http://h.org/a", "http://h.org/a/b/c.html?q=1#f", "https://u@h.org:8080/a/b/", "http://h.org/a//b/../c"]
def test_resolution_against_the_standard_library(spark):
    r = random.Random(14)
    segments = ["a", "b.html", "..", ".", "", "c d", "é", "...", "x:y"]
    leads = ["", "", "/", "./", "../", "//o.net/", "http://o.net/", "HTTPS://O.net/", "http:", "ftp://f/", "mailto:", "javascript:", "?"]
    hrefs = {r.choice(leads) + "/".join(r.choices(segments, k=r.randrange(6))) + r.choice(["", "?x=1", "?"]) + r.choice(["", "#f", "#"]) for _ in range(1500)}
    rows = [(i, b, h) for i, (b, h) in enumerate((b, h) for h in sorted(hrefs) for b in BASES)]
    got = {r.i: r.link for r in spark.createDataFrame(rows, "i int, b string, h string").select("i", web.resolve(F.col("b"), F.col("h")).alias("link")).collect()}
    wrong = []
    for i, b, h in rows:
        want = None
        if h and not h.startswith(("#", "javascript:", "mailto:")):
            whole = urljoin(b, h)
            want = whole.split("#", 1)[0] if whole.lower().startswith(("http:", "https:")) else None
        if got[i] != want:
            wrong.append((b, h, got[i], want))
    assert not wrong, (len(wrong), wrong[:8])


def test_page_links(spark):
    html = '<a href="/x">1</a><a href=x>2</a><A HREF="../y?z=1#f">3</A><a href="/x#g">4</a><!--<a href=/no>--><a href="mailto:m">5</a>'
    pages = spark.createDataFrame([(1, "http://h.org/d/p", html), (2, None, html), (3, "http://h.org/", None)], "page_id long, url string, html string")
    assert sorted(map(tuple, web.page_links(pages).collect())) == [(1, "http://h.org/d/x", 1), (1, "http://h.org/x", 0), (1, "http://h.org/y?z=1", 2)]
    plan = web.page_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
