"""WARC archives and their index.

Writing: each page becomes a WARC/1.1 record; Spark's text writer puts them into files, whose line separator is the
blank line that ends a record. Of pages with equal payloads the one with the largest id keeps it (response), the
others are revisits that refer to it and hold no payload. Reading: the text reader splits the files at the record's
first lines, which carry a number of the writing run that no payload can hold, so files of any size are read in
parallel; lengths are then checked.

Index: captures are sorted locally into runs; runs are cut at common range limits and each range is merged k ways by a
loser tree on (URL key, time, page id), which gives the globally ordered capture histories. Limits are keys with a
capture's run and place, so a hot URL is spread over several ranges, and so are captures alike in all of the key.

Defined results: null html is an empty payload; a null URL has an empty key; a null page id has page 0's time and comes
before any other of that time; pages alike in id and payload are all responses if none has a larger id. An empty table
gives no rows. Any long is a page id: times are UTC, from the id modulo 2^31, whatever the session's time zone.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import running_sum
from .common import bound_batches, drop_stage, small_side, stage_path, stage_table

#: Captures in a locally sorted run, in a written segment of it, and in a merged range (about).
RUN_ROWS = 50_000
SEGMENT_ROWS = 1024
RANGE_ROWS = 32_768
#: Captures to a key that range limits are chosen from, and keys a task sorts for that.
KEY_ROWS, KEYS_SORTED = 128, 50_000

CRLF = "\r\n"
#: Fixed value of the format: what a revisit by equal payloads says.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Time of page 0; page n is n modulo CYCLE seconds later. The pages have no time of their own.
FIRST, CYCLE = 1_700_000_000, 1 << 31


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Host labels reversed, then the path: ``http://www.a.org/b`` is ``org,a,www)/b``. Lower case."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.when(host == "", low).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _header(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends in a value are escaped."""
    safe = F.regexp_replace(value.cast("string"), r"[\r\n]", " ")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF))).otherwise("")


def capture_date(page_id: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of a page, by whole numbers and dates alone, so no time zone has a part in it."""
    t = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(CYCLE)) + FIRST
    day, second = F.floor(t / 86400).cast("int"), F.pmod(t, F.lit(86400)).cast("int")
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), clock)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, str]:
    """Writes the archives to the shared folder; returns their path and the run's number."""
    spark = pages.sparkSession
    run, path = uuid.uuid4().hex, stage_path(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload")})
    groups = rows.groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("keep")).filter("n > 1").drop("n")
    groups = stage_table(groups, "equal")
    told = rows.join(small_side(groups, groups.count(), 96), ["digest", "n_bytes"], "left")
    revisit = F.coalesce(F.col("page_id") < F.col("keep"), F.col("keep").isNotNull() & F.col("page_id").isNull())
    body = F.when(revisit, "").otherwise(F.col("payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Run-ID: {run}{CRLF}"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _header("WARC-Date", capture_date(F.col("page_id"))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Payload-Length", F.col("n_bytes")),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("keep").cast("string"), F.lit(">")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.octet_length(body)),
        F.lit(CRLF),
        body,
    )
    told.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(path)
    drop_stage(groups)
    return path, run


def read_archives(spark, path: str, run: str) -> DataFrame:
    """A row for each record: ``page_id, url, url_key, capture_time, record_type, refers_to, payload_bytes,
    payload_digest, payload``. Length and digest of a response come from its bytes, those of a revisit from its
    headers. A record shorter than it says fails the job."""
    first = f"WARC/1.1{CRLF}WARC-Run-ID: {run}{CRLF}"
    raw = spark.read.schema("value string").option("lineSep", CRLF + CRLF + first).text(path)
    head = F.substring_index("value", CRLF + CRLF, 1)
    raw = raw.withColumn("head", head)

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    page = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    content = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, field("Content-Length").cast("int"))
    checked = F.when(F.octet_length(content) == field("Content-Length").cast("int"), content).otherwise(F.raise_error(F.lit("a WARC record is shorter than its Content-Length")))
    rows = raw.select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Date"), "[^0-9]", "").alias("capture_time"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        field("WARC-Payload-Length").cast("long").alias("_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("_digest"),
        checked.alias("payload"),
    )
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        "url",
        url_key(F.col("url")).alias("url_key"),
        "capture_time",
        "record_type",
        "refers_to",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(own, base32_sha1(F.col("payload"))).otherwise(F.col("_digest")).alias("payload_digest"),
        "payload",
    )


# The index: locally sorted runs, merged by a loser tree.

CAPTURE = "struct<url_key: string, capture_time: string, page_id: long, record_type: string, refers_to: long, payload_bytes: long, payload_digest: string>"
NAMES = ["url_key", "capture_time", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
_CAPTURE = pa.struct([("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_KEY = pa.struct([("url_key", pa.string()), ("capture_time", pa.string()), ("page_id", pa.int64())])
_RUNS = pa.schema([("run", pa.int64()), ("segment", pa.int64()), ("first", _KEY), ("captures", pa.list_(_CAPTURE))])


def capture_key(c: dict) -> tuple[str, str, bool, int]:
    return c["url_key"], c["capture_time"], c["page_id"] is not None, c["page_id"] or 0


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so a step replays one path."""

    def __init__(self, runs: Iterable[Iterator[dict]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head: list[tuple | None] = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, building=True)

    def _next(self, i: int) -> tuple | None:
        c = next(self.runs[i], None)
        return None if c is None else (capture_key(c), c)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, i: int, building: bool = False) -> None:
        at = (i + self.k) // 2
        while at:
            other = self.losers[at]
            if other < 0 and building:
                self.losers[at] = i  # waits for its opponent
                return
            if self._beats(other, i):
                self.losers[at], i = i, other
            at //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.head[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.head[i][1]
            self.head[i] = self._next(i)
            self._play(i)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, held = TaskContext.get().partitionId() << 32, 0, []

    def segments():
        held.sort(key=capture_key)
        rows = [(part + number, s, {k: held[s][k] for k in _KEY.names}, held[s : s + SEGMENT_ROWS]) for s in range(0, len(held), SEGMENT_ROWS)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RUNS.types)], schema=_RUNS)

    for batch in batches:
        held += batch.to_pylist()
        if len(held) >= RUN_ROWS:
            yield segments()
            number, held = number + 1, []
    if held:
        yield segments()


def _cut(broadcast):
    schema = pa.schema([("range", pa.int64()), ("run", pa.int64()), ("segment", pa.int64()), ("n", pa.int64()), ("captures", pa.list_(_CAPTURE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = broadcast.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                keys = [(*capture_key(c), r["run"], r["segment"] * SEGMENT_ROWS + i) for i, c in enumerate(r["captures"])]
                lo = bisect.bisect_right(limits, keys[0])
                at = 0
                while at < len(keys):
                    end = bisect.bisect_left(keys, limits[lo], at) if lo < len(limits) else len(keys)
                    if end > at:
                        rows.append((lo, r["run"], r["segment"], end - at, r["captures"][at:end]))
                    at, lo = end, lo + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return run


_MERGED = pa.schema([*_CAPTURE, ("range", pa.int64()), ("at", pa.int64())])


def _merge(pieces: pa.Table) -> pa.Table:
    runs: dict[int, list[tuple[int, list[dict]]]] = {}
    for run, segment, captures in zip(*(pieces.column(n).to_pylist() for n in ("run", "segment", "captures"))):
        runs.setdefault(run, []).append((segment, captures))
    sorted_runs = ((c for _, cs in sorted(runs[r], key=lambda x: x[0]) for c in cs) for r in sorted(runs))
    rows = list(LoserTree(sorted_runs))
    told = [pa.array([r[f.name] for r in rows], f.type) for f in _CAPTURE]
    return pa.Table.from_arrays([*told, pa.array([pieces.column("range")[0].as_py()] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64())], schema=_MERGED)


def capture_histories(records: DataFrame) -> DataFrame:
    """The merged index: the captures' columns and ``history_pos``, the place in the global order from 0."""
    bound_batches(records.sparkSession)
    runs = stage_table(records.select(*NAMES).mapInArrow(_sorted_runs, f"run long, segment long, first struct<url_key: string, capture_time: string, page_id: long>, captures array<{CAPTURE}>"), "runs")
    sized = runs.agg(F.count("*").alias("k"), F.sum(F.size("captures")).alias("n")).first()
    # Every KEY_ROWS-th capture of the sorted runs, sorted in ranges; of these the driver holds one in so many, so a limit
    # stands for RANGE_ROWS captures at any size.
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size("captures") - 1) / F.lit(KEY_ROWS)).cast("int")), lambda i: F.struct(F.element_at("captures", i * KEY_ROWS + 1).alias("c"), (i * KEY_ROWS).alias("i")))
    keys = runs.select("run", "segment", F.explode(steps).alias("s")).select(*(F.col("s.c")[n].alias(n) for n in _KEY.names), "run", (F.col("segment") * SEGMENT_ROWS + F.col("s.i")).alias("place"))
    by = [*_KEY.names, "run", "place"]
    dealt = stage_table(keys.repartitionByRange(max(1, (sized["n"] or 0) // (KEY_ROWS * KEYS_SORTED)), *by).withColumn("_part", F.spark_partition_id()), "keys")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    chosen = dealt.withColumn("_i", number).filter(F.col("_i") % max(1, RANGE_ROWS // KEY_ROWS) == 0).select(*by)
    limits = records.sparkSession.sparkContext.broadcast(sorted((*capture_key(r.asDict()), r["run"], r["place"]) for r in chosen.collect()))
    pieces = stage_table(runs.mapInArrow(_cut(limits), f"range long, run long, segment long, n long, captures array<{CAPTURE}>"), "cuts")
    drop_stage(runs, dealt)
    starts = running_sum(pieces.groupBy("range").agg(F.sum("n").alias("_n")), [], "range", F.col("_n"), "_start").drop("_n")
    merged = pieces.groupBy("range").applyInArrow(_merge, "url_key string, capture_time string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, range long, at long")
    return merged.join(starts, "range").select(*NAMES, (F.col("_start") + F.col("at")).alias("history_pos"))


SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keep, lower(coalesce(url, '')) AS low FROM p
), k AS (
  SELECT *, regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host FROM g
), u AS (
  SELECT *, CASE WHEN host = '' THEN low ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
            regexp_replace(low, '^[a-z][a-z0-9+.-]*://[^/?#]*', '') END AS url_key FROM k
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       translate(array_to_string(list_transform(range(0, 8), lambda i: to_base(CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT), 32, 4)), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN coalesce(page_id < keep, page_id IS NULL AND keep IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN coalesce(page_id < keep, page_id IS NULL AND keep IS NOT NULL) THEN keep END AS refers_to,
       row_number() OVER (ORDER BY encode(url_key), (coalesce(page_id, 0) % 2147483648 + 2147483648) % 2147483648, page_id NULLS FIRST) - 1 AS history_pos
FROM u
"""
