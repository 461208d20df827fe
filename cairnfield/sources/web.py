"""Links of web pages, and server-sent events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import anchors


def admissible(href: Column) -> Column:
    """Not empty, no fragment, script or mail address."""
    return F.coalesce((href != "") & ~href.rlike("^(#|javascript:|mailto:)"), F.lit(False))


#: A reference's scheme, authority, path, query.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _joined_path(base: Column, path: Column) -> Column:
    """The path of a reference under the base's: its folder's segments and the path's, empty ones within left out, or the
    path's alone where it begins at the root; dots and double dots resolved."""
    parts = F.split(base, "/")
    folder = F.when(F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    within = lambda both: F.filter(both, lambda x, i: (i == 0) | (i == F.size(both) - 1) | (x != ""))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.array_append(done, x))

    def resolved(kept: Column) -> Column:
        done = F.aggregate(kept, F.array().cast("array<string>"), step)
        return F.array_join(F.concat(done, F.when(F.element_at(kept, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    kept = F.when(path.startswith("/"), F.split(path, "/")).otherwise(_let(F.concat(folder, F.split(path, "/")), within))
    return _let(_let(kept, resolved), lambda t: F.when(t == "", "/").when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)))


def resolve(base: Column, href: Column) -> Column:
    """The absolute http(s) URL without fragment, or null; the reference is resolved against the base by expressions."""
    bare = F.split_part(href, F.lit("#"), F.lit(1))
    cut = F.struct(bare.alias("bare"), *(_part(u, k).alias(f"{n}{k}") for n, u in (("b", base), ("r", bare)) for k in (1, 2, 3, 4)))
    question = lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))

    def joined(v: Column) -> Column:
        scheme, own = F.lower(v["b1"]), F.lower(v["r1"])
        relative = (own == "") | ((own == scheme) & ~v["bare"].rlike("^[A-Za-z0-9+.-]+://"))  # http:x is relative to an http base
        there = F.concat(scheme, F.lit("://"), F.when(v["r2"] != "", v["r2"]).otherwise(v["b2"]))
        empty = F.concat(v["b3"], question(F.when(v["r4"] == "", v["b4"]).otherwise(v["r4"])))
        below = F.when(v["r2"] != "", F.concat(v["r3"], question(v["r4"]))).when(v["r3"] == "", empty).otherwise(F.concat(_joined_path(v["b3"], v["r3"]), question(v["r4"])))
        whole = F.when(own == scheme, F.concat(own, F.lit("://"), v["r2"], v["r3"], question(v["r4"]))).otherwise(v["bare"])
        return F.when(relative, F.concat(there, below)).otherwise(whole)

    web = lambda url: F.when(F.lower(url).rlike("^https?:"), url)
    return F.when(admissible(href) & base.isNotNull(), _let(_let(cut, joined), web))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, position, link``: each page's distinct links, at the place of their first anchor."""
    told = anchors(pages, id_col, url_col, html_col).select(F.col("id").alias(id_col), "position", resolve(F.col("url"), F.col("href")).alias("link"))
    return told.filter("link is not null").groupBy(id_col, "link").agg(F.min("position").alias("position"))


class _Table(HTMLParser):
    """Collects, per ``.item`` under ``#content-core``, its headline and the links of its first table's second cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.path: list[tuple[str, str, str]] = []
        self.core = False

    def _inside(self, test) -> bool:
        return any(test(*p) for p in self.path)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = f" {a.get('class', '')} "
        if tag in ("br", "img", "hr", "input", "meta", "link"):
            return
        self.path.append((tag, a.get("id", ""), classes))
        self.core |= a.get("id") == "content-core"
        if self.core and " item " in classes:
            self.items.append({"title": "", "tables": 0, "links": [], "cell": 0, "open": None})
        if not self.items:
            return
        it = self.items[-1]
        it["tables"] += tag == "table"
        it["cell"] = 0 if tag == "tr" else it["cell"] + (tag == "td")
        if tag in ("tr", "td"):
            it["open"] = None
        if it["tables"] == 1 and tag == "a" and a.get("href") and it["cell"] == 2 and it["open"] is None and self._inside(lambda t, *_: t == "td"):
            it["open"] = {"href": a["href"], "text": "", "after": "", "closed": False}
            it["links"].append(it["open"])

    def handle_endtag(self, tag):
        while self.path and self.path.pop()[0] != tag:
            pass
        if tag == "a" and self.items and self.items[-1]["open"]:
            self.items[-1]["open"]["closed"] = True

    def handle_data(self, data):
        if not self.items:
            return
        it = self.items[-1]
        if self._inside(lambda t, _, c: t == "h2" or " headline " in c):
            it["title"] += data
        elif it["open"] and self._inside(lambda t, *_: t == "td"):
            it["open"]["after" if it["open"]["closed"] else "text"] += data


def table_links(pages: DataFrame, heading: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, ordinal, title, link, description, error`` of the table under the item whose headline holds
    ``heading``; the first of each link. A page that lacks the item or its table has one row with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, base, html in pdf.itertuples(index=False):
                t = _Table()
                t.feed(html or "")
                item = next((i for i in t.items if heading in " ".join(i["title"].split())), None)
                if item is None or not item["tables"]:
                    rows.append((key, None, None, None, None, "heading not found" if item is None else "table not found"))
                    continue
                seen = set()
                for x in item["links"]:
                    link = urljoin(base or "", x["href"]).split("#", 1)[0]
                    if link.startswith(("http:", "https:")) and link not in seen:
                        seen.add(link)
                        rows.append((key, len(seen) - 1, " ".join(x["text"].split()), link, " ".join(x["after"].split()), None))
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "title", "link", "description", "error"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInPandas(run, "page_id long, ordinal int, title string, link string, description string, error string")


def parse_sse(streams: DataFrame, key: str, body: str) -> DataFrame:
    """``key, seq, event, data`` of server-sent event streams: blocks split at blank lines, line ends normalised."""
    blocks = F.split(F.regexp_replace(F.col(body), r"\r\n?", "\n"), "\n\n")
    each = streams.select(key, F.posexplode(blocks).alias("seq", "_b")).filter(F.trim("_b") != "")
    field = lambda n: F.regexp_extract("_b", rf"(?m)^{n}: ?(.*)$", 1)
    return each.select(key, "seq", field("event").alias("event"), field("data").alias("data"))


def fold_events(events: DataFrame, key: str, seq: str, event: str, text: str) -> DataFrame:
    """``key, answer, n_tokens, failed``: token events joined in order; an error event marks the stream failed."""
    token = F.col(event) == "token"
    parts = F.sort_array(F.collect_list(F.when(token, F.struct(seq, text))))
    return events.groupBy(key).agg(F.array_join(parts[text], "").alias("answer"), F.count_if(token).alias("n_tokens"), F.max(F.col(event) == "error").alias("failed"))
