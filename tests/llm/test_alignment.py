"""Cross-tokenizer alignment: the skipping against byte-by-byte computation, odd inputs, both ways back to the texts."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnfield.llm import alignment
from cairnfield.llm.tokens import byte_letters, vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def bytewise(text, libraries):
    """(ids a, ids b, groups, linked id pairs) of a text: which token each byte belongs to, byte by byte."""
    t, s = libraries
    if not text:
        return None
    letters = byte_letters()
    a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
    piece = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    parts = [[bytes(letters[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    owner = [[k for k, x in enumerate(p) for _ in x] for p in parts]
    links = list(dict.fromkeys(zip(*owner)))
    n = len(owner[0])
    ends = [p for p in range(1, n + 1) if all(p == n or o[p] != o[p - 1] for o in owner)]
    groups = [[sorted(set(o[x:y])) for o in owner] for x, y in zip([0, *ends], ends)]
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def plainly(rows, libraries):
    found = [bytewise(t, libraries) for _, t in rows]
    counts = Counter(p for f in found if f for p in f[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a  b   c    d", "▁", "a▁b", "<s> </s> <unk> <|endoftext|> <0x41>", "naïve Ünïcode ßtraße", "日本語 テキスト 🎉👩‍👩‍👧", "\x00\x01\x7f", "﻿bom", "é é ﬁ Å", "  　", "tab\tand\r\nline", "a" * 300, "12345 67,890.12", "...!!!???",
]


def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.mark.parametrize("most", [alignment.HEAD_PAIRS, 60])
def test_rows(spark, sf_dir, libraries, most):
    """All pairs broadcast, and the frequent ones alone."""
    rows = [*documents(sf_dir), *((10_000 + k, t) for k, t in enumerate(ODD)), (None, "no id"), (3, "twice the same"), (3, "twice the same")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pair string, row int").repartition(3)
    got = alignment.digests(docs, most=most)
    assert sorted(map(str, map(tuple, got.collect()))) == plainly(rows, libraries)


def test_split_counts(spark):
    counts = spark.createDataFrame([(i, n, False) for i, n in enumerate([100, 90, 70, 9, 8, 3, 2, 1, 1, 1])], "pair long, n long, best boolean")
    head, tail = alignment.split_counts(counts, 5)
    assert {r.n for r in head.collect()} == {100, 90, 70, 9, 8} and tail.count() == 5
    head, tail = alignment.split_counts(counts, 2)  # three pairs share the highest power
    assert head.count() == 0 and tail.count() == 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=80), st.lists(st.booleans(), max_size=80))
def test_align(x, y):
    """Any two cuttings of so many bytes."""
    n = max(len(x), len(y)) + 1
    a, b = ([i + 1 for i, c in enumerate(s) if c and i + 1 < n] + [n] for s in (x, y))
    cuts_a, cuts_b, links_a, links_b = alignment.align(a, b)
    links = sorted(zip(links_a.tolist(), links_b.tolist()))
    assert [a[i - 1] for i in cuts_a] == [b[j - 1] for j in cuts_b] == sorted(set(a) & set(b))
    owner = lambda ends: [k for k, (lo, hi) in enumerate(zip([0, *ends], ends)) for _ in range(lo, hi)]
    assert links == list(dict.fromkeys(zip(owner(a), owner(b))))


def test_long_runs_take_few_steps():
    class Counted(list):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return list.__getitem__(self, k)

    ends = list(range(1, 200_001))
    cuts, _, links, _ = alignment.align(Counted(ends), Counted(ends))
    assert len(cuts) == len(links) == 200_000 and Counted.looks < 200


def test_long_texts_are_cut_without_a_trace(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 40)
    pieces, rng = alignment.PieceTokens(B), random.Random(5)
    assert pieces.can_cut
    words = ["the", "Straße", "naïve", "  ", " ", "\n", "▁", "x" * 50, "日本", "<s>", "1234", ".", "a  b", "😀"]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(120)))
        assert pieces.encode(text).tolist() == libraries[1].encode(text)


def test_a_long_text(spark, libraries):
    rows = [(1, "Some words, einige Wörter and more. " * 30_000), (2, "x" * 100_000)]
    got = alignment.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == plainly(rows, libraries)


def test_spans(spark, libraries):
    rows = [(1, "An unusually tokenised Straße"), (2, None), (3, "plain words")]
    got = alignment.spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "group").collect()
    for i, t in rows:
        mine, told = [r for r in got if r.doc_id == i], bytewise(t, libraries)
        assert [(r.a_ids, r.b_ids) for r in mine] == ([([told[0][k] for k in x], [told[1][k] for k in y]) for x, y in told[2]] if told else [])
        assert not mine or [r.start for r in mine[1:]] == [r.end for r in mine[:-1]] and mine[-1].end == len((" " + t).encode())


def test_empty_table(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
