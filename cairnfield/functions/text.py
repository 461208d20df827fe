"""Text functions as Columns; a pandas UDF only where Spark has no builtin (compatibility folding)."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that strip and a pattern's white space agree on.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Line ends other than a line feed.
OTHER_ENDS = r"\r\n?|[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def norm_space(c: Column) -> Column:
    """Stripped, runs of white space as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


@functools.cache
def _fold_udf():
    def fold(s: pd.Series) -> pd.Series:
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return s.map(lambda t: t if t is None or t.isascii() else plain(t))

    return F.pandas_udf(fold, "string")


def ascii_fold(c: Column) -> Column:
    """NFKD without combining marks: accents go, ligatures and fractions are expanded."""
    return _fold_udf()(c)


def norm_key(c: Column) -> Column:
    """Folded, lower case, everything but a-z, 0-9 and + as one space."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9+]+", " "))


def norm_header(c: Column) -> Column:
    return F.lower(norm_space(ascii_fold(F.coalesce(c, F.lit("")))))


def sanitize_name(c: Column) -> Column:
    """Line ends and bullets as spaces, dashes as hyphens, trailing asterisks off, folded, first letter upper case."""
    t = norm_space(F.translate(c, "\n•", "  "))
    t = strip(F.regexp_replace(F.translate(t, "–—", "--"), r"\*+$", ""))
    t = norm_space(ascii_fold(t))
    first = F.substring(t, 1, 1)  # one character stays one: Spark's upper makes two of a sharp s
    return F.concat(F.when(first == "ß", "ẞ").otherwise(F.upper(first)), F.substring(t, 2, 2**31 - 1))


def code_base(c: Column) -> Column:
    """The code a label asks for, before it is made unique."""
    t = F.regexp_replace(F.replace(F.upper(ascii_fold(c)), F.lit("+"), F.lit(" MAIS ")), "[^A-Z0-9]+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    t = F.when(t == "", "MEDICAMENTO").otherwise(t)
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("MED_"), t)).otherwise(t)


def clean_markdown(c: Column) -> Column:
    """Lines of one to four digits alone dropped, the rest stripped, with a line end unless empty."""
    body = _clean_body(c)
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def _clean_body(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, OTHER_ENDS, "\n"), r"(?Um)^[^\S\n]*\d{1,4}[^\S\n]*$\n?", ""))


def with_clean(df: DataFrame, source: str, out: str) -> DataFrame:
    """``clean_markdown`` as a column: the body is a projection of its own, so it is computed once however often the
    result is used."""
    body = df.withColumn("_body", _clean_body(F.col(source)))
    return body.withColumn(out, F.when(F.col("_body") == "", "").otherwise(F.concat("_body", F.lit("\n")))).drop("_body")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def parse_lines(c: Column) -> Column:
    """Lines stripped, empty ones dropped; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")


def non_blank(c: Column, default: str) -> Column:
    return F.when(strip(c) != "", strip(c)).otherwise(F.lit(default))


def url_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def url_slug(c: Column) -> Column:
    """The last name of the URL's path (or ``document``), runs other than word characters, dots, hyphens as ``_``."""
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.substring(F.regexp_replace(F.when(name == "", "document").otherwise(name), r"(?U)[^\w.\-]+", "_"), 1, 180)


def local_filename(url: Column, content_type: Column) -> Column:
    """The slug; ``.pdf`` added if the content is PDF, else, without any dot, ``.html`` or ``.bin`` by content."""
    slug, kind = url_slug(url), F.lower(F.coalesce(content_type, F.lit("")))
    pdf, dotted = F.lower(slug).endswith(".pdf"), slug.contains(".")
    suffix = F.when(pdf, "").when(kind.contains("pdf"), ".pdf").when(dotted, "").when(kind.contains("html"), ".html").otherwise(".bin")
    return F.concat(slug, suffix)


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def preview(c: Column, n: int) -> Column:
    """Line ends as spaces, the first n characters."""
    return F.substring(F.translate(c, "\n", " "), 1, n)


def title(c: Column, n: int = 42) -> Column:
    """The text, or its first n - 2 characters and an ellipsis where it is longer than n."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 2), F.lit("…"))).otherwise(c)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``, with forward slashes; a path elsewhere stays."""
    p, r = F.translate(path, "\\", "/"), root.rstrip("/") + "/"
    return F.when(p.startswith(r), F.substring(p, len(r) + 1, 2**31 - 1)).otherwise(p)


def hashed_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the md5 of the parts: the same for the same row in every run. Null parts count as ``null``."""
    return F.concat(F.lit(f"{prefix}-"), F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))))
