import gzip
import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import media

KINDS = {"audio/wav": 0, "audio/basic": 1, "image/bmp": 2, "image/png": 3}


def payload_of(kind):
    return next(p for i in range(200) if zlib.crc32(p := media.padded(f"text {i} BM RIFF .snd GIF8".encode())) % 4 == KINDS[kind])


@pytest.mark.parametrize("kind", KINDS)
def test_formats_are_confirmed_and_lossless(kind):
    p = payload_of(kind)
    stored = media.store(p)
    assert media.split(stored) == (kind, []) and media.samples(stored, kind) == p
    assert media.split(stored[:-1])[0] is None and media.split(stored + b"x")[0] is None


@given(st.binary(max_size=300))
def test_any_payload_round_trips(b):
    p = media.padded(b)
    stored = media.store(p)
    assert len(p) % 576 == 0 and p and p.startswith(b) and media.samples(stored, media.split(stored)[0]) == p


def test_other_formats():
    gif = b"GIF89a" + bytes((1, 0, 1, 0, 0x80, 0, 0)) + bytes(6) + b"\x2c" + bytes((0, 0, 0, 0, 1, 0, 1, 0, 0)) + b"\x02\x02\x44\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"
    pdf = b"%PDF-1.4\n...\nstartxref\n9\n%%EOF"
    gz = gzip.compress(b"hello" * 100)
    for kind, data in (("image/gif", gif), ("image/jpeg", jpeg), ("application/pdf", pdf), ("application/gzip", gz)):
        assert media.split(data) == (kind, [])
        assert media.find(b"prose BM GIF8 " + data + b" more")[-1] == (kind, 14, len(data))
    assert media.find(b"RIFF BM %PDF- \x1f\x8b\x08 .snd GIF89a \xff\xd8\xff\x89PNG\r\n\x1a\n") == []


def test_sniff_and_carve(spark):
    png = media.store(payload_of("image/png"))
    rows = [(1, b"see " + png + b" there", "text/plain"), (2, png, "image/jpeg"), (3, None, None), (4, b"", "x"), (5, png, "image/png")]
    df = spark.createDataFrame(rows, "id long, media binary, declared string").withColumn("_media", F.lit(1)).withColumn("type", F.lit("clash"))
    got = {r.id: r for r in media.sniff(df, "media", "declared").collect()}
    assert [(got[i].sniffed_type, got[i].type_corrected, len(got[i].embedded)) for i in range(1, 6)] == [(None, False, 1), ("image/png", True, 0), (None, False, 0), (None, False, 0), ("image/png", False, 0)]
    carved = media.carve(df.drop("_media", "type"), "media", "id").collect()
    assert [(r.id, r.type, r.offset, bytes(r.content)) for r in carved] == [(1, "image/png", 4, png)]


def test_documents(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 5000), (5, "abc"), (None, "x")]
    got = media.read_media(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        p = media.padded((t or "").encode())
        assert (by[i].n_bytes, by[i].payload_bytes, by[i].payload_sha256, by[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert by[1][1:] == by[5][1:] and by[2][1:] == by[3][1:]
    assert media.read_media(media.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_many_magic_numbers_without_an_end_take_linear_time():
    import time

    wave = b"RIFF\x00\x00\x10\x00WAVE" + b"fmt \x04\x00\x00\x00RIFF" + b"\x00\x00\x0f\x00WAVEdata\x00\x00\x00\x00"
    png = b"\x89PNG\r\n\x1a\n" + media._chunk(b"IHDR", bytes(13)) + b"\x00\x03\x00\x00tEXt"
    for magic in (b"%PDF-1.", b"\xff\xd8\xff\xda\x00\x02", b"GIF89a1234567!x", b"GIF89a1234567!\xf9\x01", png, wave):
        began = time.process_time()
        assert media.find(magic * 60_000) == []
        assert time.process_time() - began < 20


def test_a_text_of_megabytes(spark):
    text = "long ünd %PDF-1.4 text " * 100_000
    [r] = media.read_media(media.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    whole = media.padded(text.encode())
    assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(whole)) and r.payload_sha256 == hashlib.sha256(whole).hexdigest()


def plain_wav(b, o):
    end, at, seen = o + 8 + int.from_bytes(b[o + 4 : o + 8], "little"), o + 12, set()
    if b[o + 8 : o + 12] != b"WAVE" or o + 12 > len(b) or end > len(b):
        return None
    while at + 8 <= end:
        seen.add(b[at : at + 4])
        n = int.from_bytes(b[at + 4 : at + 8], "little")
        at += 8 + n + (n & 1)
    return end - o if at == end and {b"fmt ", b"data"} <= seen else None


def plain_gif(b, o):
    table = lambda f: 3 << ((f & 7) + 1) if f & 0x80 else 0
    if b[o + 4 : o + 6] not in (b"7a", b"9a") or o + 13 > len(b):
        return None
    at = o + 13 + table(b[o + 10])
    while at < len(b):
        if b[at] == 0x3B:
            return at + 1 - o
        if b[at] == 0x21:
            at += 2
        elif b[at] == 0x2C and at + 10 < len(b):
            at += 11 + table(b[at + 9])
        else:
            return None
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return None


_PIECES = [b"RIFF", b"WAVE", b"fmt ", b"data", b"GIF89a", b"1234567", b"!x", b",", b";", bytes(10), b"LIST", *(n.to_bytes(4, "little") for n in (0, 1, 2, 4, 12, 20, 24, 28, 36, 60, 100, 300))]


@given(st.lists(st.sampled_from(_PIECES), max_size=120))
def test_walks_kept_agree_with_walks_made_anew(parts):
    b = b"".join(parts)
    marks = media.Marks(b)
    for o in range(len(b)):
        if b[o : o + 4] == b"RIFF":
            assert media._wav(b, o, marks) == plain_wav(b, o)
        if b[o : o + 4] == b"GIF8":
            assert media._gif(b, o, marks) == plain_gif(b, o)


def test_nested_waves():
    inner = b"RIFF" + (4 + 8 + 16 + 8 + 4).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes(16) + b"data" + (4).to_bytes(4, "little") + b"abcd"
    outer = b"RIFF" + (4 + 8 + 16 + 8 + len(inner)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + bytes(16) + b"data" + len(inner).to_bytes(4, "little") + inner
    assert media.find(outer) == [("audio/wav", 0, len(outer)), ("audio/wav", 44, len(inner))] and plain_wav(outer, 0) == len(outer)


@given(st.binary(min_size=1, max_size=400), st.data())
def test_checksums_of_stretches(b, data):
    import random

    b = random.Random(b).randbytes(2 * media.Marks.CRC_STEP) + b * 300
    marks, x = media.Marks(b), data.draw(st.integers(0, len(b)))
    y = data.draw(st.integers(x, len(b)))
    assert marks.crc(x, y) == zlib.crc32(b[x:y]) == marks._crc_to(y) ^ media.crc_moved(marks._crc_to(x), y - x)
