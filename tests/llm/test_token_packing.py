import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import bestfit, packing, tokens

ODD = [None, "", " ", "  ", "a b", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "\n \n b", "x\n  y", "x\n ", "a \x1c b", "é ñ!? 12 's it's", "\t a", "<|endoftext|> x", "w" * 5000, "one, two. three! " * 900, "\r\r \r"]


def ids_of(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    return [np.array([*(e.exact.encode(t or "", add_special_tokens=False).ids), 0], "<u4") for t in texts]


def equal(texts):
    e = tokens.encoder(tokens.vocabulary_path())
    return [t for t, want in zip(texts, ids_of(texts)) if [*e.encode(t).tolist(), 0] != want.tolist()]


def test_odd_texts_and_every_kind_of_character():
    points = [*range(0x3000), *range(0x3000, 0xD800, 53), *range(0xE000, 0x110000, 211)]
    assert tokens.encoder(tokens.vocabulary_path()).fast and not equal(ODD + [f"a{chr(c)}b {chr(c)} 1{chr(c)}2  {chr(c)}{chr(c)} .{chr(c)}." for c in points])


def test_very_long_texts():
    assert not equal(["a" * 200_000, " " * 3_000_000 + "x", "y\n" * 50_000, "\n" * 16_000 + "z", ". " * 50_000, "ab\n\n  " * 30_000])


def test_another_vocabulary_goes_through_tokenizers():
    e = tokens.Encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    assert e.fast is None and e.encode("Hello there").tolist() == e.exact.encode("Hello there", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ab.,!\n\r\té1'", max_size=40))
def test_any_text_has_its_ids(t):
    assert not equal([t])


def check(pieces, rows, length=1024):
    want = {i: ids for (i, _), ids in zip(rows, ids_of([t for _, t in rows]))}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == want.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i]) and p.ids_crc32 == zlib.crc32(want[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(want[i])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    return by_sequence


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1))


def test_online_packing(spark):
    rows = list(enumerate(ODD)) + [(100 + i, "word " * (i * 13 % 700)) for i in range(600)]
    got = packing.pack(frame(spark, rows)).collect()
    sequences = check(got, rows)
    assert 1 - sum(p.length for p in got) / (1024 * len(sequences)) < 0.1
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in got)
    assert packing.pack(frame(spark, [])).count() == 0


def test_windows_stay_bounded_and_fullest_goes_first():
    w = packing.Windows(0, length=10, most=2)
    assert [w.place(n) for n in (4, 7, 6)] == [(0, 0, None), (1, 0, None), (0, 4, None)]
    assert w.place(5) == (2, 0, None) and w.place(9) == (3, 0, 1) and len(w.open) == 2


@given(st.lists(st.integers(1, 1023), max_size=80))
def test_merge_keeps_every_window(sizes):
    moves = packing.best_fit_merge(list(enumerate(sizes)))
    assert sorted(m[0] for m in moves) == list(range(len(sizes)))
    spans = {}
    for w, to, base in moves:
        spans.setdefault(to, []).append((base, base + sizes[w]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


@given(st.lists(st.lists(st.integers(1, 200), min_size=1, max_size=5), max_size=40))
def test_merged_pieces_lie_apart_in_no_more_windows(windows):
    pieces = [(w, sum(sizes[:k]), n) for w, sizes in enumerate(windows) for k, n in enumerate(sizes)]
    size, spans = {(w, at): n for w, at, n in pieces}, {}
    moves = packing.merge_pieces(pieces)
    assert sorted(m[:2] for m in moves) == sorted(size)
    for w, at, to, base in moves:
        spans.setdefault(to, []).append((base, base + size[w, at]))
    assert len(spans) <= len(windows)
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_matrices_round_trip(spark):
    rows = list(enumerate(ODD)) + [(100 + i, "word " * (i * 17 % 900)) for i in range(300)] + [(999, "very long text, " * 150_000)]
    matrices = bestfit.write_matrices(frame(spark, rows))
    check(bestfit.read_pieces(matrices).collect(), rows)
    for m in matrices.collect():
        assert len(m.ids) == 4096 and m.cu_seqlens[0] == 0 and m.position_resets == m.cu_seqlens[:-1] and len(m.segments) == len(m.position_resets)
        assert not any(m.ids[4 * m.cu_seqlens[-1] :])
    assert bestfit.write_matrices(frame(spark, [])).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing_is_the_plain_one(sizes):
    got = bestfit.best_fit_decreasing(sizes, 32)
    free, want = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [b for b in range(len(free)) if free[b] >= sizes[i]]
        b = min(fits, key=lambda b: free[b]) if fits else len(free)
        if not fits:
            free.append(32)
            want.append([])
        want[b].append(i)
        free[b] -= sizes[i]
    fill = lambda bins: sorted(sum(sizes[i] for i in b) for b in bins)
    assert sorted(i for b in got for i in b) == list(range(len(sizes))) and fill(got) == fill(want)


@given(st.lists(st.integers(1, 45), max_size=150), st.integers(1, 6), st.sampled_from([8, 10, 16]))
def test_online_placement_is_the_plain_one(sizes, most, length):
    """Every piece against a list of open windows that is looked through whole each time."""
    windows, got = packing.Windows(0, length, most), []
    for n in sizes:
        got += list(packing.pieces_of(n, length, windows))
    number, still, want = 0, {}, []  # window -> fill
    for n in sizes:
        at = 0
        while n - at >= length:
            want.append((at, length, number, 0))
            number, at = number + 1, at + length
        rest = n - at
        if not rest:
            continue
        fits = [w for w, fill in still.items() if fill + rest <= length]
        if fits:
            w = min(fits, key=lambda w: (length - still[w], w))
        else:
            if len(still) == most:
                del still[min(still, key=lambda w: (length - still[w], w))]
            w, number = number, number + 1
            still[w] = 0
        want.append((at, rest, w, still[w]))
        still[w] += rest
        if still[w] == length:
            del still[w]
    assert got == want


def test_texts_of_megabytes_through_spark(spark):
    text = "Wörter and words, 123 " * 120_000
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, " " * 40_000)], "doc_id long, text string")
    sizes = {i: len(tokens.encoder(tokens.vocabulary_path()).encode(t)) + 1 for i, t in ((1, text), (2, "short"), (3, None), (4, " " * 40_000))}
    for rows in (packing.pack(docs, keep_ids=False).collect(), bestfit.read_pieces(bestfit.write_matrices(docs)).collect()):
        for i, n in sizes.items():
            mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert [a for a, _ in mine] == [sum(k for _, k in mine[:j]) for j in range(len(mine))] and sum(k for _, k in mine) == n
            assert all(r.doc_tokens == n for r in rows if r.doc_id == i)
