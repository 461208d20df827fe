"""Pages to text, sections and chunks with page ranges.

Offsets are exact by construction. Separators between pages count, as the stitched text has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import BATCH_ROWS, bound_batches, table_of
from .intervals import page_ranges
from .windows import WIDTH, running_sum

SIZE, OVERLAP = 1600, 200
GAP = 2
#: Separators from coarse to fine, and the levels of the header lines.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
HEADERS = (2, 3)


def page_spans(pages: DataFrame, stem: str, page: str, text: str) -> DataFrame:
    """``stem, page, start, end``: where each page lies in its document's stitched text (pages joined by a blank
    line). A null text is empty."""
    sized = table_of(pages.select(F.col(stem).alias("stem"), F.col(page).alias("page"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n")), "sizes")  # texts are read once
    placed = running_sum(sized, ["stem"], "page", F.col("n") + GAP, "start")
    return placed.select("stem", "page", "start", (F.col("start") + F.col("n")).alias("end"))


def stitch(pages: DataFrame, stem: str, page: str, text: str) -> DataFrame:
    """``stem, text``: non-blank pages in order, joined by a blank line, with a line end."""
    some = pages.filter(F.trim(F.col(text)) != "")
    parts = some.groupBy(stem).agg(F.sort_array(F.collect_list(F.struct(page, text))).alias("_p"))
    return parts.select(stem, F.concat(F.array_join(F.col("_p")[text], "\n\n"), F.lit("\n")).alias("text"))


def whole_texts(pages: DataFrame, stem: str, page: str, text: str) -> DataFrame:
    """``stem, text``: all pages in order, blank ones too, joined by a blank line, as ``page_spans`` counts them: a row
    per document, since its sections run over pages."""
    parts = pages.groupBy(F.col(stem).alias("stem")).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("_p"))
    return parts.select("stem", F.array_join("_p.text", "\n\n").alias("text"))


def n_chunks(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Fixed-stride chunks of a text: none if empty, each but the last of full size."""
    return F.when(length <= 0, 0).when(length <= size, 1).otherwise(F.ceil((length - overlap) / F.lit(size - overlap))).cast("int")


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``key, chunk_index, start, end, chunk`` of every whole text."""
    counted = docs.select(key, F.col(text).alias("_t"), n_chunks(F.length(text), size, overlap).alias("_n")).filter("_n > 0")
    each = counted.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("chunk_index") * (size - overlap)
    return each.select(key, "chunk_index", start.alias("start"), F.least(start + size, F.length("_t")).alias("end"), F.substring("_t", start + 1, F.lit(size)).alias("chunk"))


def chunk_page_ranges(spans: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``stem, chunk_index, page_start, page_end`` of the fixed-stride chunks of stitched documents.

    A span [s, e) overlaps the chunks whose numbers lie in a range that arithmetic gives, so no range join is needed:
    spans are exploded to those numbers and aggregated. A chunk that touches no page has the range (1, 1)."""
    step = size - overlap
    ends = spans.groupBy("stem").agg(F.max("end").alias("length"))
    told = spans.join(ends, "stem").withColumn("n", n_chunks(F.col("length"), size, overlap))
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size) / F.lit(step)) + 1)
    high = F.least(F.col("n") - 1, F.floor((F.col("end") - 1) / F.lit(step)))
    hits = told.filter(F.col("end") > F.col("start")).withColumns({"low": low, "high": high}).filter("low <= high")
    touched = hits.withColumn("chunk_index", F.explode(F.sequence("low", "high"))).groupBy("stem", "chunk_index").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    every = ends.withColumn("n", n_chunks(F.col("length"), size, overlap)).filter("n > 0").select("stem", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("chunk_index"))
    return every.join(touched, ["stem", "chunk_index"], "left").select("stem", "chunk_index", *(F.coalesce(c, F.lit(1)).cast("long").alias(c) for c in ("page_start", "page_end")))


def next_fence(fence: str, line: str) -> str:
    """The code fence open after a stripped line, if ``fence`` was open before it ("" for none): a line that begins with
    tildes, or with the only three backquotes in it, opens one; a line that begins with the open one's mark closes it."""
    if fence:
        return "" if line.startswith(fence) else fence
    if line.startswith("```") and line.count("```") == 1:
        return "```"
    return "~~~" if line.startswith("~~~") else ""


def header_sections(markdown: str, levels: tuple[int, int] = HEADERS) -> list[tuple[str | None, str | None, int, str]]:
    """(header 1, header 2, start, body) of the sections under header lines of the two levels; a new header of the first
    clears the second. Header lines are no part of a body; lines of other levels, and all lines in a code fence, are
    text. A header line is the level's marks alone, or followed by a space."""
    out, h1, h2, begin, at, fence = [], None, None, 0, 0, ""
    marks = ["#" * n for n in levels]

    def end_section(upto: int) -> None:
        if markdown[begin:upto].strip():
            out.append((h1, h2, begin, markdown[begin:upto]))

    for line in markdown.split("\n"):
        shown = "".join(c for c in line.strip() if c.isprintable())
        fence = next_fence(fence, shown)
        level = None if fence else next((k for k, m in enumerate(marks) if shown == m or shown.startswith(m + " ")), None)
        if level is not None:
            end_section(at)
            title = shown[len(marks[level]) :].strip()
            h1, h2 = (title, None) if level == 0 else (h1, title)
            begin = min(at + len(line) + 1, len(markdown))
        at += len(line) + 1
    end_section(len(markdown))
    return out


def _cuts(text: str, start: int, end: int, separator: str) -> list[tuple[int, int]]:
    """Spans between separators, each separator at the beginning of the span after it; characters if it is empty."""
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    at = [start, *(m.start() for m in re.finditer(re.escape(separator), text[start:end]))]
    at = [start, *(start + i for i in at[1:] if i), end]
    return [(a, b) for a, b in zip(at, at[1:]) if b > a]


def _stripped(text: str, a: int, b: int) -> list[tuple[int, int]]:
    part = text[a:b]
    a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
    return [(a, b)] if b > a else []


def _windows(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Successive spans joined while they fit ``size``; the next piece begins with the last ones that fit ``overlap``."""
    out, low = [], 0
    for k, (a, b) in enumerate(spans):
        if low < k and b - spans[low][0] > size:
            out += _stripped(text, spans[low][0], a)
            while low < k and (a - spans[low][0] > overlap or b - spans[low][0] > size):
                low += 1
    return out + (_stripped(text, spans[low][0], spans[-1][1]) if spans else [])


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size`` characters: the text is cut at the first separator it holds, spans
    that are still too long at the next ones, and successive short spans are joined, with an overlap. Pieces are
    stripped; a blank text has none. Every piece is a span of the text, so its offsets are exact."""

    def split(start: int, end: int, left: tuple[str, ...]) -> list[tuple[int, int]]:
        k = next((i for i, s in enumerate(left) if not s or s in text[start:end]), len(left) - 1)
        out, short = [], []
        for a, b in _cuts(text, start, end, left[k]):
            if b - a < size or k + 1 == len(left):
                short.append((a, b))
                continue
            out += _windows(text, short, size, overlap) + split(a, b, left[k + 1 :])
            short = []
        return out + _windows(text, short, size, overlap)

    return split(0, len(text), separators)


def breadcrumb_of(h1: str | None, h2: str | None) -> str:
    return " > ".join(h.strip() for h in (h1, h2) if h and h.strip()) or "(sem cabeçalho)"


_CHUNKS = "source_stem string, section string, header_1 string, header_2 string, chunk_index int, start int, end int, text string"


def section_chunks(docs: DataFrame, stem: str, text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, headers: tuple[int, int] = HEADERS) -> DataFrame:
    """Sections split recursively: a row for each piece, with exact offsets in the document's text; blank sections
    have none. Per-document Python, since separators are tried in turn."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, body in zip(pdf["stem"], pdf["text"]):
                index = 0
                for h1, h2, at, section in header_sections(body or "", headers):
                    name = breadcrumb_of(h1, h2)
                    for a, b in recursive_pieces(section, size, overlap, separators):
                        rows.append((key, name, h1, h2, index, at + a, at + b, section[a:b]))
                        index += 1
                        if len(rows) == BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
            yield pd.DataFrame(rows, columns=names)

    names = ["source_stem", "section", "header_1", "header_2", "chunk_index", "start", "end", "text"]
    bound_batches(docs.sparkSession)  # batches hold whole texts
    return docs.select(F.col(stem).cast("string").alias("stem"), F.col(text).alias("text")).mapInPandas(run, _CHUNKS)


def sections(docs: DataFrame, stem: str, text: str, headers: tuple[int, int] = HEADERS) -> DataFrame:
    """``source_stem, section, header_1, header_2, start, end, text``: the sections of every whole text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(key, breadcrumb_of(h1, h2), h1, h2, at, at + len(body), body) for key, whole in zip(pdf["stem"], pdf["text"]) for h1, h2, at, body in header_sections(whole or "", headers)]
            yield pd.DataFrame(rows, columns=["source_stem", "section", "header_1", "header_2", "start", "end", "text"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(stem).cast("string").alias("stem"), F.col(text).alias("text")).mapInPandas(run, "source_stem string, section string, header_1 string, header_2 string, start int, end int, text string")


def page_chunks(pages: DataFrame, stem: str, page: str, text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, headers: tuple[int, int] = HEADERS, width: int = WIDTH) -> DataFrame:
    """Pages to recursive chunks: ``chunk_id``, the columns of ``section_chunks`` and ``page_start, page_end``.

    Sections and pieces are cut in the stitched text; which pages a piece touches comes from an interval lookup over
    offsets alone, so only the chunks' own text is joined to it. A page without a stem is an error, as in ``chunk_id``."""
    chunks = table_of(section_chunks(whole_texts(pages, stem, page, text), "stem", "text", size, overlap, separators, headers), "chunks")
    spans = page_spans(pages.withColumn(stem, F.col(stem).cast("string")), stem, page, text)
    places = chunks.select(F.col("source_stem").alias("stem"), "chunk_index", "start", "end")
    told = page_ranges(places, spans, width).select(F.col("stem").alias("_stem"), F.col("chunk_index").alias("_index"), "page_start", "page_end")
    both = chunks.join(told, (F.col("source_stem") == F.col("_stem")) & (F.col("chunk_index") == F.col("_index")))
    return both.select(chunk_id(F.col("source_stem"), F.col("chunk_index")).alias("chunk_id"), *chunks.columns, "page_start", "page_end")


def chunk_id(stem: Column, index: Column) -> Column:
    """``stem:index``; a null stem is an error, as a missing key is."""
    checked = F.coalesce(stem.cast("string"), F.raise_error(F.lit("a chunk without source_stem")).cast("string"))
    return F.concat(checked, F.lit(":"), index.cast("string"))


def flat_metadata(df: DataFrame, column: str) -> Column:
    """A struct column as a map of strings: nulls dropped, lists as JSON with ``, `` between items."""
    entries = []
    for f in df.schema[column].dataType.fields:
        c = F.col(column)[f.name]
        if f.dataType.typeName() == "array":
            items = F.transform(c, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""))
            c = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        entries.append(F.when(c.isNotNull(), F.struct(F.lit(f.name).alias("key"), c.cast("string").alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def neighbours(chunks: DataFrame, n: Column, index: str = "chunk_index") -> DataFrame:
    """Adds ``prev_index`` and ``next_index`` of a document's ``n`` chunks, numbered from 0: no window is needed."""
    i = F.col(index)
    return chunks.withColumns({"prev_index": F.when(i > 0, i - 1), "next_index": F.when(i + 1 < n, i + 1)})
