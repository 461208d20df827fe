"""Anchors of HTML as browsers read it: an automaton over tags, attributes, comments and raw text.

``anchor_hrefs`` is the automaton of one page; ``anchors`` runs it over a table, a row for each anchor with an href.
Which links these are is said by ``web.resolve``, without Python.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no markup.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
#: An attribute's name (a leading = belongs to it) and its value: quoted either way, bare, or none.
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9=;]))")
_END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_LINE_ENDS = re.compile(r"[\t\r\n]")


def attribute_value(raw: str) -> str:
    """Character references resolved; a name without semicolon is none where a letter, digit or = follows."""
    return _REFERENCE.sub(lambda m: html.unescape(m[0]), raw) if "&" in raw else raw


def _tag(text: str, at: int) -> tuple[int, list[tuple[str, str]]]:
    """(place after the tag, its attributes) from the place after its name; the text's end if it does not close."""
    found, n = [], len(text)
    while True:
        at = _SPACE.match(text, at).end()
        if at >= n:
            return n, []  # a tag that never closes is none
        if text[at] == ">":
            return at + 1, found
        m = _ATTRIBUTE.match(text, at)
        if m.end() == at or (m.lastindex == 1 and m[0].endswith("=") and text[m.end() : m.end() + 1] in ("'", '"')):
            return n, []  # an open quote runs to the end
        found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()


def _past(text: str, at: int) -> int:
    """The place after a tag whose attributes are not asked for: after the next >, unless a quote may hold that."""
    end = text.find(">", at)
    if end < 0:
        return len(text)
    return end + 1 if text.find('"', at, end) < 0 and text.find("'", at, end) < 0 else _tag(text, at)[0]


def _after(text: str, what: str, at: int) -> int:
    end = text.find(what, at)
    return len(text) if end < 0 else end + len(what)


def anchor_hrefs(text: str) -> list[str]:
    """The href of each ``a`` element that has one, in order; the first, where a tag has several."""
    out, at = [], 0
    while (at := text.find("<", at)) >= 0:
        at += 1
        if text.startswith("!--", at):
            # <!--> and <!---> are whole comments
            at = at + 4 if text.startswith(">", at + 3) else at + 5 if text.startswith("->", at + 3) else _comment_end(text, at + 3)
        elif text[at : at + 1] in ("!", "?") or (text.startswith("/", at) and text[at + 1 : at + 2] not in (">", "") and not text[at + 1].isalpha()):
            at = _after(text, ">", at)
        elif text.startswith("/", at):
            m = _NAME.match(text, at + 1)
            at = _past(text, m.end()) if m else at
        elif m := _NAME.match(text, at):
            name = m[0].lower()
            if name != "a":
                at = _past(text, m.end())
            else:
                at, attributes = _tag(text, m.end())
                href = next((v for k, v in attributes if k == "href"), None)
                if href is not None:
                    out.append(_LINE_ENDS.sub("", attribute_value(href)).strip())
            if name in _END_OF_RAW:
                end = _END_OF_RAW[name].search(text, at)
                at = end.start() if end else len(text)
    return out


def _comment_end(text: str, at: int) -> int:
    ends = [e for e in (_after(text, "-->", at), _after(text, "--!>", at)) if e]
    return min(ends)


def anchors(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``id, url, position, href`` of each page's anchors that have an href, numbered from 0; null html has none."""
    kinds = dict(pages.dtypes)
    schema = pa.schema([("position", pa.int32()), ("href", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor_hrefs(x.as_py() or "") for x in batch.column(2)]
            rows = pa.array([i for i, hs in enumerate(found) for _ in hs], pa.int64())
            places = pa.array([p for hs in found for p in range(len(hs))], schema.types[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), places, pa.array([h for hs in found for h in hs], pa.string())], names=["id", "url", *schema.names])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url string, position int, href string")
