"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators.

The automaton finds every magic number in a binary value; a validator then walks the format's structure and confirms
it with its length. What is confirmed at offset 0 over the whole value corrects the declared type; what is confirmed
elsewhere is embedded media and can be carved.

``store`` keeps a payload losslessly as 8-bit samples (WAVE or AU audio, BMP or PNG grey images, chosen by the
payload's crc); ``samples`` reads the payload back from the confirmed structure.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stage_table

#: Samples in a row of a stored image; payloads are padded to a multiple.
WIDTH = 576
PAD = b"\xff"
RATE = 8000

#: Fixed values of the formats: magic numbers.
MAGIC = {
    "audio/wav": b"RIFF",
    "audio/basic": b".snd",
    "image/bmp": b"BM",
    "image/png": b"\x89PNG\r\n\x1a\n",
    "image/gif": b"GIF8",
    "image/jpeg": b"\xff\xd8\xff",
    "application/gzip": b"\x1f\x8b\x08",
    "application/pdf": b"%PDF-",
}


# Validators: (bytes, offset, what is known of the value) -> length of the media that begins there, or None. Walks from
# place to place are kept in ``Marks``, so that no place is walked twice, however many magic numbers lead to it.


def _wav(b: bytes, o: int, marks: Marks) -> int | None:
    if b[o + 8 : o + 12] != b"WAVE" or o + 12 > len(b):
        return None
    end = o + 8 + struct.unpack_from("<I", b, o + 4)[0]
    met = marks.chunks.between(o + 12, end) if end <= len(b) else None
    return end - o if met and all(met) else None


def _au(b: bytes, o: int, marks: Marks) -> int | None:
    if o + 24 > len(b):
        return None
    start, size, code, rate, channels = struct.unpack_from(">5I", b, o + 4)
    ok = start >= 24 and 1 <= code <= 27 and rate and 1 <= channels <= 64 and size != 0xFFFFFFFF and o + start + size <= len(b)
    return start + size if ok else None


def _bmp(b: bytes, o: int, marks: Marks) -> int | None:
    if o + 54 > len(b):
        return None
    size, zero, start, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, o + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or header not in (40, 108, 124) or width <= 0 or not height:
        return None
    whole = start + (width * bits + 31) // 32 * 4 * abs(height)
    return size if size == whole and o + size <= len(b) else None


def _png(b: bytes, o: int, marks: Marks) -> int | None:
    """The first chunk is IHDR, 13 bytes long by the format; the others are walked."""
    if b[o + 8 : o + 16] != b"\x00\x00\x00\x0dIHDR" or o + 33 > len(b) or struct.unpack_from(">I", b, o + 29)[0] != zlib.crc32(b[o + 12 : o + 29]):
        return None
    end = marks.png.end(o + 33)
    return end - o if end else None


def _png_chunk(marks: Marks, at: int) -> tuple[bool, int | None]:
    b = marks.b
    if at + 12 > len(b):
        return True, None
    n, kind = struct.unpack_from(">I", b, at)[0], b[at + 4 : at + 8]
    end = at + 12 + n
    if end > len(b) or kind == b"IHDR" or struct.unpack_from(">I", b, end - 4)[0] != marks.crc(at + 4, end - 4):
        return True, None
    return kind == b"IEND", end


def _gif_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif(b: bytes, o: int, marks: Marks) -> int | None:
    if b[o + 4 : o + 6] not in (b"7a", b"9a") or o + 13 > len(b):
        return None
    end = marks.gif.end(o + 13 + _gif_table(b[o + 10]))
    return end - o if end else None


def _gif_block(marks: Marks, at: int) -> tuple[bool, int | None]:
    b = marks.b
    if at >= len(b):
        return True, None
    if b[at] == 0x3B:
        return True, at + 1
    if b[at] == 0x21:
        return False, marks.gif_data.end(at + 2)
    if b[at] == 0x2C and at + 10 < len(b):
        return False, marks.gif_data.end(at + 11 + _gif_table(b[at + 9]))
    return True, None


def _gif_data(marks: Marks, at: int) -> tuple[bool, int]:
    """Sub-blocks up to an empty one."""
    return (True, at + 1) if at >= len(marks.b) or not marks.b[at] else (False, at + 1 + marks.b[at])


@functools.cache
def _crc_zeros(k: int) -> tuple[int, ...]:
    """What 2^k zero bytes make of each bit of a crc32."""
    if k == 0:
        one = lambda c: functools.reduce(lambda x, _: (x >> 1) ^ (0xEDB88320 if x & 1 else 0), range(8), c)
        return tuple(one(1 << i) for i in range(32))
    half = _crc_zeros(k - 1)
    return tuple(_crc_apply(half, x) for x in half)


def _crc_apply(matrix: tuple[int, ...], crc: int) -> int:
    out = 0
    for m in matrix:
        if crc & 1:
            out ^= m
        crc >>= 1
    return out


def crc_moved(crc: int, n: int) -> int:
    """What ``crc`` adds to the crc32 of ``n`` more bytes."""
    k = 0
    while n:
        if n & 1:
            crc = _crc_apply(_crc_zeros(k), crc)
        n, k = n >> 1, k + 1
    return crc


class Walk:
    """Where walks end: ``step(place)`` tells (True, the end) or (False, the next place, a greater one)."""

    def __init__(self, step: Callable[[int], tuple[bool, int | None]]) -> None:
        self.step, self.known = step, {}

    def end(self, at: int) -> int | None:
        passed, done = [], False
        while not done and at not in self.known:
            passed.append(at)
            done, at = self.step(at)
        found = at if done else self.known[at]
        self.known.update(dict.fromkeys(passed, found))
        return found


class Chunks:
    """Chains of chunks with little-endian lengths: whether a chain meets a place, and which kinds it has before it.

    Each place knows the next, one far ahead (by skew binary numbers, so any place is met in few jumps), and how many
    chunks of each kind follow."""

    KINDS = (b"fmt ", b"data")

    def __init__(self, b: bytes) -> None:
        self.b, self.at = b, {}  # place -> (depth, next, far, counts)

    def _learn(self, place: int) -> None:
        path = []
        while place not in self.at:
            if place + 8 > len(self.b):
                self.at[place] = (0, place, place, (0, 0))
                break
            path.append(place)
            n = struct.unpack_from("<I", self.b, place + 4)[0]
            place += 8 + n + (n & 1)
        for p in reversed(path):
            depth, _, far, counts = self.at[place]
            further = self.at[far]
            jump = further[2] if depth - further[0] == further[0] - self.at[further[2]][0] else place
            kind = self.b[p : p + 4]
            self.at[p] = (depth + 1, place, jump, tuple(c + (kind == k) for c, k in zip(counts, self.KINDS)))
            place = p

    def between(self, place: int, end: int) -> tuple[int, ...] | None:
        """Chunks of each kind from ``place`` on up to ``end``; None if the chain does not meet it."""
        self._learn(place)
        first = here = self.at[place]
        while place < end and here[0]:
            place = here[2] if here[2] <= end else here[1]
            here = self.at[place]
        return tuple(x - y for x, y in zip(first[3], here[3])) if place == end else None


class Marks:
    """What is known of a value, found once for all validators: where some bytes occur, where walks end."""

    #: Bytes between the places whose checksum from the beginning is kept.
    CRC_STEP = 1 << 16

    def __init__(self, b: bytes) -> None:
        self.b, self.found, self.crcs = b, {}, [0]
        self.chunks = Chunks(b)
        self.png, self.gif, self.gif_data = (Walk(functools.partial(step, self)) for step in (_png_chunk, _gif_block, _gif_data))

    def _crc_to(self, end: int) -> int:
        """The crc32 of the value up to ``end``."""
        k = end // self.CRC_STEP
        while len(self.crcs) <= k:
            n = len(self.crcs)
            self.crcs.append(zlib.crc32(self.b[(n - 1) * self.CRC_STEP : n * self.CRC_STEP], self.crcs[-1]))
        return zlib.crc32(self.b[k * self.CRC_STEP : end], self.crcs[k])

    def crc(self, start: int, end: int) -> int:
        """The crc32 of a stretch; of a long one by those of the value up to its ends."""
        if end - start <= 2 * self.CRC_STEP:
            return zlib.crc32(self.b[start:end])
        return self._crc_to(end) ^ crc_moved(self._crc_to(start), end - start)

    def places(self, what: bytes) -> list[int]:
        if what not in self.found:
            self.found[what] = [m.start() for m in re.finditer(re.escape(what), self.b)]
        return self.found[what]

    def next(self, what: bytes, at: int) -> int:
        """The first place from ``at`` on, or -1."""
        i = bisect.bisect_left(self.places(what), at)
        return self.places(what)[i] if i < len(self.places(what)) else -1

    def last(self, what: bytes, end: int) -> int:
        """The last place that ends by ``end``, or -1."""
        i = bisect.bisect_right(self.places(what), end - len(what))
        return self.places(what)[i - 1] if i else -1


def _jpeg(b: bytes, o: int, marks: Marks) -> int | None:
    at = o + 2
    while at + 4 <= len(b) and b[at] == 0xFF and 0xC0 <= b[at + 1] <= 0xFE and b[at + 1] not in (0xD8, 0xD9):
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return None
        scan, at = b[at + 1] == 0xDA, at + 2 + n
        if scan:
            end = marks.next(b"\xff\xd9", at)
            return end + 2 - o if end >= 0 else None
    return None


def _gzip(b: bytes, o: int, marks: Marks) -> int | None:
    stream, at = zlib.decompressobj(31), o
    try:
        while not stream.eof and at < len(b):
            part = stream.unconsumed_tail or b[at : at + 65536]
            at += 0 if stream.unconsumed_tail else len(part)
            stream.decompress(part, 1 << 20)
    except zlib.error:
        return None
    return at - len(stream.unused_data) - o if stream.eof else None


def _pdf(b: bytes, o: int, marks: Marks) -> int | None:
    if not b[o + 5 : o + 6].isdigit() or b[o + 6 : o + 7] != b"." or marks.next(b"startxref", o) < 0:
        return None
    nxt = marks.next(b"%PDF-", o + 5)
    end = marks.last(b"%%EOF", nxt if nxt >= 0 else len(b))
    return end + 5 - o if end >= o else None


VALIDATORS: dict[str, Callable[..., int | None]] = {
    "audio/wav": _wav,
    "audio/basic": _au,
    "image/bmp": _bmp,
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "application/gzip": _gzip,
    "application/pdf": _pdf,
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def find(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all confirmed media in ``data``, by offset."""
    out, marks = [], Marks(data)
    for end, (kind, n) in _automaton().iter(data.decode("latin-1")):
        length = VALIDATORS[kind](data, end + 1 - n, marks)
        if length:
            out.append((kind, end + 1 - n, length))
    return out


def split(data: bytes) -> tuple[str | None, list[tuple[str, int, int]]]:
    """(the whole value's own type or None, embedded media)."""
    found = find(data)
    own = next((k for k, o, n in found if o == 0 and n == len(data)), None)
    return own, [x for x in found if not (x[0] == own and x[1] == 0)]


# Storing a payload, and reading it back.


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(text: bytes) -> bytes:
    return text + PAD * (-len(text) % WIDTH or (0 if text else WIDTH))


def store(payload: bytes) -> bytes:
    """The payload (a positive multiple of WIDTH bytes) as 8-bit samples."""
    n, height = len(payload), len(payload) // WIDTH
    kind = zlib.crc32(payload) % 4
    if kind == 0:
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload
    if kind == 1:
        return struct.pack(">4s5I", b".snd", 24, n, 2, RATE, 1) + payload
    if kind == 2:
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + n, 0, 1078, 40, WIDTH, -height, 1, 8, 0, n, 0, 0, 256, 0) + grey + payload
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return MAGIC["image/png"] + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples of what ``store`` wrote, by its confirmed type."""
    if kind == "audio/wav":
        return data[44:]
    if kind == "audio/basic":
        return data[struct.unpack_from(">I", data, 4)[0] :]
    if kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    width, height = struct.unpack_from(">II", data, 16)
    at, packed = 8, b""
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        packed += data[at + 8 : at + 8 + n] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


# Spark operators.


def sniff(df: DataFrame, media_col: str, declared_col: str | None = None) -> DataFrame:
    """``df`` with ``sniffed_type`` (null if nothing spans the whole value), ``type_corrected`` (it differs from the
    declared type) and ``embedded`` (type, offset, length). Null media: null type, nothing embedded."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("sniffed_type string, embedded array<struct<type: string, offset: long, length: long>>")
    def run(media: pd.Series) -> pd.DataFrame:
        found = [split(bytes(m)) if m is not None else (None, []) for m in media]
        return pd.DataFrame({"sniffed_type": [k for k, _ in found], "embedded": [[{"type": t, "offset": o, "length": n} for t, o, n in e] for _, e in found]})

    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    out = df.withColumn("_sniff", run(F.col(media_col)))
    return out.select(*df.columns, F.col("_sniff.sniffed_type"), (F.col("_sniff.sniffed_type").isNotNull() & ~F.col("_sniff.sniffed_type").eqNullSafe(declared)).alias("type_corrected"), F.col("_sniff.embedded"))


def carve(df: DataFrame, media_col: str, *keep: str) -> DataFrame:
    """A row for each embedded media of each value: the kept columns, ``type, offset, length, content``."""
    each = sniff(df, media_col).select(*keep, F.col(media_col).alias("_media"), F.explode("embedded").alias("_e"))
    content = F.substring(F.col("_media"), (F.col("_e.offset") + 1).cast("int"), F.col("_e.length").cast("int"))
    return each.select(*keep, F.col("_e.type"), F.col("_e.offset"), F.col("_e.length"), content.alias("content"))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media_type", pa.string()), ("n_embedded", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary()))
        yield _batch([(d, len(t), store(padded(t))) for d, t in zip(batch.column(0).to_pylist(), texts)], _STORED)


def _features(payload: bytes) -> str:
    """Mean, deviation, entropy (bits) and share of padding-valued samples."""
    p = np.bincount(np.frombuffer(payload, np.uint8), minlength=256) / len(payload)
    mean = float(p @ np.arange(256))
    spread = math.sqrt(max(0.0, float(p @ np.arange(256) ** 2) - mean * mean))
    entropy = -float(np.sum(p[p > 0] * np.log2(p[p > 0])))
    return f"mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};ff={p[255]:.4f}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            media = value.as_buffer().to_pybytes()
            kind, embedded = split(media)
            payload = samples(media, kind)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{kind};{_features(payload)}", kind, len(embedded)))
        yield _batch(rows, _READ)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text (null: empty), padded and stored as 8-bit samples, in a written
    table. Repeated rows are stored each; an empty table gives an empty one; other columns are not read."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stage_table(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, all from the bytes read back; the type is the sniffed one."""
    return stored.mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_embedded long")
