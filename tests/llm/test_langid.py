import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cairnfield.llm import langid

PARTS = {"xx": ["the", "ing", "tion", "and", "wh"], "yy": ["ñe", "ció", "que", "los", "ar"], "zz": ["üb", "sch", "ung", "der", "ein"]}


def text(lang, seed, words=40):
    r = random.Random(seed)
    return " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 3))) for _ in range(words))


def test_gradients():
    rng = np.random.default_rng(0)
    m = langid.fresh(["a", "b", "c"], hidden=3)
    m = langid.Model(m.languages, [t.astype(float) for t in m.table], [u.astype(float) for u in m.u], m.out.astype(float), m.bias.astype(float))
    x, y = rng.integers(60, 130, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(m, x, y)
    for p, g in zip(m.params(), grads):
        for _ in range(8):
            i = (int(rng.integers(p.shape[0])), int(x.flat[rng.integers(x.size)]) if p.shape[1] == 256 else int(rng.integers(p.shape[1])))
            old, ends = p[i], []
            for step in (1e-4, -1e-4):
                p[i] = old + step
                ends.append(langid.gradients(m, x, y)[0])
            p[i] = old
            assert abs((ends[0] - ends[1]) / 2e-4 - g[i]) < 1e-5


def test_labelling_equals_the_trained_forward_pass():
    m = langid.fresh(["a", "b"], hidden=4)
    x = np.random.default_rng(1).integers(0, 256, (6, 64)).astype(np.uint8)
    f, b = langid._forward(m.table[0], m.u[0], x.T), langid._forward(m.table[1], m.u[1], x.T[::-1])
    states = np.stack([np.concatenate([p[5], q[5]]) for p, q in zip(f, b[::-1])])
    want = langid.softmax((m.out @ states + m.bias).transpose(1, 0, 2)).transpose(1, 0, 2)
    assert np.allclose(langid.Labeller(m).positions(x), want, atol=1e-5)


def test_cut_keeps_every_byte():
    texts = [b"", b"a" * 64, b"b" * 65, b"c", b""]
    s, n = langid.cut(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    assert n.tolist() == [0, 1, 2, 1, 0] and b"".join(s.tobytes().split(b"\0")) == b"".join(texts)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [(i, text(k, i), k) for i in range(450) for k in [list(PARTS)[i % 3]]]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 !? 34", "xx"), (1003, "é", None), (None, text("zz", 5), "zz"), (1004, text("yy", 9, 20_000), None), (7, rows[7][1], "yy")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit("clash"))
    got = langid.identify(df, langid.fit(df))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) + len(odd)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= by[i].score <= 1 for i, _, _ in rows)
    held = [(by[i].lang_pred, k) for i, _, k in rows if by[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang_pred in PARTS and by[1004].lang_pred == "yy" and by[None].lang_pred == "zz"
    kept = langid.keep_identified(df, langid.fit(df))
    assert kept.columns == df.columns and kept.count() == len(rows) + len(odd) - 3


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.fit(none) is None
    assert [(r.lang_pred, r.score) for r in langid.identify(none, None).collect()] == [("und", 0.0)]
    assert langid.identify(none.limit(0), langid.fit(none.limit(0))).count() == 0


def test_pooling_against_position_by_position():
    """A text's probabilities are the mean over its letter bytes of the distributions, stretch by stretch."""
    m = langid.fresh(["a", "b", "c"], hidden=4)
    labeller = langid.Labeller(m)
    texts = [b"", b"12 !", b"hello there", "é ñ".encode() * 90, b"x" * 64, b"y." * 300]
    got = labeller.pooled(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    for t, p in zip(texts, got):
        total, letters = np.zeros(3), 0
        for lo in range(0, len(t), langid.STRETCH):
            part = t[lo : lo + langid.STRETCH]
            x = np.zeros((1, langid.STRETCH), np.uint8)
            x[0, : len(part)] = list(part)
            at = labeller.positions(x)[:, :, 0]
            for i, b in enumerate(part):
                if chr(b).isascii() and chr(b).isalpha() or b >= 128:
                    total, letters = total + at[i], letters + 1
        assert np.allclose(p, total / max(1, letters), atol=1e-5)


def test_rows_without_an_id_are_not_learned_from(spark):
    rows = spark.createDataFrame([(None, "abc", "xx"), (None, "def", "yy")], "doc_id long, text string, lang string")
    assert langid.fit(rows) is None
