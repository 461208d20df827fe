"""Quality rules: base counts and verdicts against a plain computation, odd inputs."""

import hashlib
import math
import re
from collections import Counter

import pytest

from cairnfield.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[!-/:-@\[-^`{-~]+")


def counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    h = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in TOKEN.findall(low)]
    return [x % 65536 for x in h] + [(x * 40503 + y) % 65536 for x, y in zip(h, h[1:])]


def plainly(rows, trusted):
    """(doc_id, base counts, base_failed, kept, score) of (doc_id, text) rows."""
    fold = lambda i: int(hashlib.md5(f"quality:{i}".encode()).hexdigest()[:13], 16) / 2**52 < 0.2
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(t or "")
        raw.update(g)
        if i in trusted and not fold(i):
            target.update(g)
    r, t = sum(raw.values()), sum(target.values())
    weight = {b: round(1e6 * (math.log((target[b] + 1) / (t + 65536)) - math.log((n + 1) / (r + 65536)))) if t else 0 for b, n in raw.items()}
    out = []
    for i, text in rows:
        c, g = counts(text or ""), grams(text or "")
        out.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0], math.floor(sum(weight[b] for b in g) / len(g)) if g else 0))
    good = [x[-1] for x in out if not x[-2] and x[0] in trusted and fold(x[0])]
    mean = sum(good) / len(good) if good else 0
    cut = min(-100000.0, mean - 6 * math.sqrt(max(0, sum(s * s for s in good) / len(good) - mean * mean))) if good else -100000.0
    return [(*x[:-1], not x[-2] and (not t or x[-1] >= cut), x[-1]) for x in out]


@pytest.fixture(scope="module")
def docs():
    clean = [(i, " ".join(f"word{(i * 7 + k * (k + i)) % 97}" for k in range(60 + i % 30)) + ".\nThe end, of it.") for i in range(120)]
    junk = [(1000 + i, " ".join(f"word{(i * 5 + k * k) % 89}###$$" for k in range(80))) for i in range(40)]
    odd = [(2000, ""), (2001, None), (2002, "  \n\t"), (2003, "a b c " * 40), (2004, "same line\n" * 30), (2005, "x"), (2006, "é 😀 <|>   w" * 20), (None, "no id " * 30), (3, clean[3][1]), (3, clean[3][1]), (2007, "a b c a b c d"), (2008, "long " * 200_000)]
    return clean + junk + odd


def as_rows(df):
    return sorted(map(str, map(tuple, df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect())))


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, score int")


def test_rows(spark, docs):
    labels = [(i, 1, 9) for i in range(0, 120, 2)] + [(i, 0, 9) for i in range(1000, 1040)] + [(7, 1, 9), (7, 0, 9), (None, 1, 9), (9, None, 9), (4, 1, 9), (99999, 1, 9)]
    table, told = frames(spark, docs, labels)
    got = quality.judge(table, quality.trusted_ids(told))
    want = plainly(docs, set(range(0, 120, 2)))
    assert as_rows(got) == sorted(map(str, want))
    kept = {r.doc_id for r in got.filter("kept").collect()}
    assert kept >= set(range(120)) and not kept & set(range(1000, 1040)), "junk goes, clean documents stay"
    assert quality.keep_good(table, got).columns == table.columns
    assert {r.doc_id for r in quality.keep_good(table, got).collect()} == kept


@pytest.mark.parametrize("labels", [[], [(5, 0, 1)]])
def test_without_trusted_documents_the_base_rules_decide(spark, docs, labels):
    table, told = frames(spark, docs, labels)
    got = quality.judge(table, quality.trusted_ids(told))
    assert as_rows(got) == sorted(map(str, plainly(docs, set())))
    assert got.filter("kept = base_failed").count() == 0


def test_empty_table(spark):
    table, told = frames(spark, [], [])
    assert quality.judge(table, quality.trusted_ids(told)).count() == 0
