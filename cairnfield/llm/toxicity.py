"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps the words of a clause to classes: abuse (words and stems learned from labels), violence, intention,
copula, target, object, speaker, negation, report, quotation mark, other. Transducers over these sequences are composed, arc by arc as they are met, into
one grammar:

* insult: abuse becomes a loose insult, or a direct one where a target and a copula stand just before it;
* threat: a violent verb becomes a threat only with an intention of the speaker or of somebody unnamed before it (or at
  the clause's beginning, as an order) and a victim: an object just before or, a guess to be met, a target after it;
  first-person forms need the victim alone;
* negation: marks insults and threats within three words after a negator;
* reported speech: marks what follows a verb of saying in the clause, and what stands before one that follows a comma or
  quotation mark (a guess to be met);
* target: aims the loose insults of a clause that addresses somebody.

The best path scores each clause; a logistic model over a document's clause scores, fitted on a bounded sample, gives its
probability. Violent words outside these patterns count nothing.

Defined results: null and empty texts have no clause and get the score of a document without matches; without labels of
both kinds the score is the share of label 1, or 0. Repeated rows are scored each; whole texts are read; columns other
than text are no inputs. Rows without an id are scored but never learned from.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches
from .langid import held_out

#: The sample the model is fitted on: labelled documents of either kind, and bytes of their whole texts, at most.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_BYTES = 1000, 3000, 32 << 20
#: An abusive word must be in so many different toxic texts, with such log odds, and so unlikely by chance (twice the log
#: likelihood ratio: one in a million); a stem after so many different endings besides, none of them in most of its texts.
LEAST_DOCS, LEAST_ODDS, LEAST_RATIO, LEAST_ENDINGS = 4, 1.5, 24.0, 5
#: A longer stem is taken for a shorter one from such a share of its log likelihood ratio.
NEARLY = 0.85
STEM_LENGTHS = (4, 5, 6, 7)
MOST_WEIGHT = 6.0
THREAT_WEIGHT = 6.0
SEED = 11

# Word classes of the four languages.
VIOLENCE = {
    "kill", "murder", "hurt", "harm", "stab", "shoot", "strangle", "choke", "destroy", "attack", "punch", "smash", "crush",
    "töten", "umbringen", "verletzen", "schlagen", "verprügeln", "erschießen", "erwürgen", "vernichten", "zerstören", "erstechen",
    "tuer", "frapper", "blesser", "assassiner", "égorger", "étrangler", "détruire", "cogner",
    "matar", "golpear", "asesinar", "herir", "destruir", "estrangular", "apuñalar", "lastimar",
    "matarte", "golpearte", "asesinarte", "herirte", "destruirte",
}
FIRST_PERSON = {
    "töte", "schlage", "erschieße", "verletze", "vernichte", "tuerai", "frapperai", "blesserai", "détruirai", "tue", "frappe",
    "mataré", "golpearé", "asesinaré", "heriré", "destruiré", "mato",
}
SPEAKERS = {"i", "we", "somebody", "someone", "ich", "wir", "jemand", "je", "nous", "on", "quelqu", "yo", "nosotros", "alguien"}
INTENTIONS = {
    "will", "ll", "gonna", "going", "should", "shall", "must", "want", "ought", "werden", "soll", "sollte", "muss", "devrait", "faut", "debería",
}
FIRST_INTENTIONS = {"let", "werde", "möchte", "vais", "allons", "veux", "voy", "vamos", "quiero"}
COPULAS = {"are", "re", "r", "were", "bist", "seid", "es", "êtes", "eres", "sois", "son", "remain", "bleibst", "restes"}
#: Targets that may be subjects, and those that can't.
TARGETS = {"you", "u", "du", "ihr", "tu", "usted", "ustedes", "tú", "vosotros"}
OBJECTS = {
    "your", "yours", "yourself", "dich", "dir", "dein", "deine", "euch", "toi", "te", "vous", "votre", "ton", "ti",
    "matarte", "golpearte", "asesinarte", "herirte", "destruirte",
}
NEGATIONS = {"not", "no", "never", "nobody", "isn", "aren", "don", "won", "nicht", "kein", "keine", "nie", "niemals", "ne", "pas", "jamais", "nunca", "jamás", "ningún"}
QUOTES = set(',"“”„«»')
REPORTS = {"said", "says", "wrote", "claimed", "quoted", "reported", "sagte", "schrieb", "behauptete", "dit", "écrit", "affirme", "dijo", "escribió", "afirma"}

#: What a unit of lexicon weight counts as a loose, aimed and direct insult and as a threat, and what
#: negation and reported speech leave of it.
KINDS = {"i": 1.0, "I": 1.25, "d": 1.5, "h": 1.0}
MARKS = {"": 1.0, "-": 0.2, "~": 0.5, "-~": 0.1}
FACTORS = {k + m: x * y for k, x in KINDS.items() for m, y in MARKS.items()}

#: How many words apart: target and copula, these and the abuse; intention and verb, verb and target; negator and match.
NEAR, DIRECT_REACH, INTENT_REACH, TARGET_REACH, NEGATION_REACH = 2, 4, 5, 3, 3
#: Words between a speaker and the intention, and between a comma or quotation mark and the verb of saying after it.
AGENT_REACH, REPORT_REACH = 3, 3
#: Clauses of a lesser score count by it alone, not as one more match.
COUNTED = 2.0

WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\W\d_]+|[" + "".join(sorted(QUOTES)) + "]")
CLAUSE = re.compile(r"[^.!?;:\n]+")

Arc = tuple[str, float, object]


class Transducer:
    """A weighted transducer: ``step(state, symbol)`` gives (output, weight, next state) of each arc, ``final(state)``
    whether a path may end. Arcs are made when first asked for, and kept: the states are finite."""

    def __init__(self, start: object, move: Callable[[object, str], list[Arc]], final: Callable[[object], bool] = lambda s: True) -> None:
        self.start, self.final = start, functools.cache(final)
        self.step = functools.cache(move)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of a's output, weights added."""

    def move(s: tuple, x: str) -> list[Arc]:
        return [(z, u + v, (p, q)) for y, u, p in a.step(s[0], x) for z, v, q in b.step(s[1], y)]

    return Transducer((a.start, b.start), move, lambda s: a.final(s[0]) and b.final(s[1]))


def insult() -> Transducer:
    """State: words for which a target, a copula, and both together still count. Abuse (a) becomes i or d."""

    def move(s: tuple, x: str) -> list[Arc]:
        if x == "c":
            return [(x, 0.0, s)]
        target, copula, both = (max(0, k - 1) for k in s)
        if x in "ty":
            target, both = NEAR, DIRECT_REACH if s[1] else both
        elif x == "k":
            copula, both = NEAR, DIRECT_REACH if s[0] else both
        elif x == "a":
            return [("d" if s[2] else "i", 0.0, (target, copula, DIRECT_REACH if s[2] else 0))]
        return [("o" if x == "k" else x, 0.0, (target, copula, both))]

    return Transducer((0, 0, 0), move)


def threat() -> Transducer:
    """State: words for which a speaker, an intention and a victim still count, words within which a guessed victim is due.

    A violent verb (v; f in the first person) becomes h or o; a verb that holds its victim (w) needs the intention only.
    An intention (m) is one only soon after a speaker (s), or as a clause's first word, where the speaker is left out;
    p has its speaker in its form. Before the verb only an object (y) is a victim: ``you`` (t) is a subject there, be it
    before the intention (you will hurt) or after it (I want you to)."""

    def move(s: tuple, x: str) -> list[Arc]:
        if x == "c":
            return [(x, 0.0, s)]
        agent, intent, victim = (max(0, k - 1) for k in s[:3])
        met = x in "tyw"
        due = 0 if met else s[3] - 1
        if s[3] and not met and not due:
            return []  # the guess was wrong
        due = max(0, due)
        if x == "s":
            return [("o", 0.0, (AGENT_REACH, intent, victim, due))]
        if x == "p" or x == "m":
            return [("o", 0.0, (agent, INTENT_REACH if x == "p" or s[0] else intent, victim, due))]
        if x in "ty":
            return [("t", 0.0, (agent, 0 if x == "t" and s[1] and not s[3] else intent, TARGET_REACH if x == "y" else victim, due))]
        if x not in "vfw":
            return [(x, 0.0, (agent, intent, victim, due))]
        told, none = ("h", 0.0, (agent, intent, victim, due)), ("o", 0.0, (agent, intent, victim, due))
        if x == "w":
            return [told if s[1] else none]
        if x == "v" and not s[1]:
            return [none]
        return [told] if s[2] else [none, ("h", 0.0, (agent, intent, victim, TARGET_REACH))]

    return Transducer((1, 1, 0, 0), move, lambda s: not s[3])


def negation() -> Transducer:
    def move(s: int, x: str) -> list[Arc]:
        if x == "c":
            return [(x, 0.0, s)]
        if x == "n":
            return [("o", 0.0, NEGATION_REACH)]
        return [(x + "-" if s and x in KINDS else x, 0.0, max(0, s - 1))]

    return Transducer(0, move)


def reported() -> Transducer:
    """State: what is known of reports (none; plain: a match stands unmarked; due: one is marked on the guess of a verb of
    saying to come; met), and words within which such a verb, after a comma or quotation mark (c), tells what was before.

    A verb there ends the paths that left a match unmarked; one elsewhere marks what follows it."""

    def move(s: tuple, x: str) -> list[Arc]:
        known, reach = s
        if x == "c":
            return [("o", 0.0, (known, REPORT_REACH))]
        left = max(0, reach - 1)
        if x == "r":
            if reach:
                return [] if known == "plain" else [("o", 0.0, ("met", left))]
            return [("o", 0.0, (known if known in ("due", "plain") else "met", left))]
        if x[0] not in KINDS:
            return [(x, 0.0, (known, left))]
        marked = x + "~"
        if known == "none":
            return [(x, 0.0, ("plain", left)), (marked, 0.0, ("due", left))]
        return [(x, 0.0, (known, left))] if known == "plain" else [(marked, 0.0, (known, left))]

    return Transducer(("none", 0), move, lambda s: s[0] != "due")


def target() -> Transducer:
    """A loose insult is aimed if its clause has a target, before it or (a guess, to be met) after it."""

    def move(s: str, x: str) -> list[Arc]:
        if x == "t":
            return [("o", 0.0, "seen")]
        if x[0] != "i":
            return [(x, 0.0, s)]
        aimed = "I" + x[1:]
        return [(x, 0.0, s), (aimed, 0.0, "due")] if s == "none" else [(aimed, 0.0, s)]

    return Transducer("none", move, lambda s: s != "due")


def scored() -> Transducer:
    return Transducer(0, lambda s, x: [(x, FACTORS.get(x, 0.0), 0)])


CASCADE = (insult, threat, negation, reported, target, scored)


@functools.cache
def grammar() -> Transducer:
    return functools.reduce(compose, (part() for part in CASCADE))


def clause_score(g: Transducer, tokens: list[tuple[str, float]]) -> float:
    """The best path's sum of arc weight times token weight over a clause of (class, weight)."""
    best = {g.start: 0.0}
    for x, w in tokens:
        now: dict[object, float] = {}
        for s, v in best.items():
            for _, u, n in g.step(s, x):
                if v + u * w > now.get(n, -math.inf):
                    now[n] = v + u * w
        best = now
    return max((v for s, v in best.items() if g.final(s)), default=0.0)


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)  # abusive words, matched whole
    stems: dict[str, float] = field(default_factory=dict)  # beginnings of abusive words
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))
    prior: float = 0.0  # the score if nothing could be fitted


def word_class(word: str) -> str:
    if word in VIOLENCE:
        return "w" if word in OBJECTS else "v"
    classes = (("f", FIRST_PERSON), ("t", TARGETS), ("y", OBJECTS), ("s", SPEAKERS), ("n", NEGATIONS), ("r", REPORTS), ("p", FIRST_INTENTIONS), ("m", INTENTIONS), ("k", COPULAS), ("c", QUOTES))
    for kind, words in classes:
        if word in words:
            return kind
    return "o"


class Scorer:
    """Matches a text against the lexicon, then scores the clauses that have a match."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.grammar, self.auto = grammar(), ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, float, bool]]] = defaultdict(list)
        for w in VIOLENCE | FIRST_PERSON:
            entries[w].append((word_class(w), THREAT_WEIGHT, True))
        for found, whole in ((words, True), (stems, False)):
            for w, x in found.items():
                entries[w].append(("a", x, whole))
        for w, told in entries.items():
            self.auto.add_word(w, (len(w), told))
        self.auto.make_automaton()

    def hits(self, low: str) -> dict[int, tuple[str, float]]:
        """Word start -> (class, weight) of the heaviest match at it."""
        found: dict[int, tuple[str, float]] = {}
        for end, (n, told) in self.auto.iter(low):
            at = end + 1 - n
            if at and low[at - 1].isalpha():
                continue
            inside = low[end + 1 : end + 2].isalpha()
            for kind, x, whole in told:
                if not (whole and inside):
                    found[at] = max(found.get(at, (kind, -1.0)), (kind, x), key=lambda y: y[1])
        return found

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, score) of each clause, in the lower-cased text, that a pattern matches."""
        low = (text or "").lower()
        hits = self.hits(low)
        if not hits:
            return []
        at, out = sorted(hits), []
        for m in CLAUSE.finditer(low):
            k = bisect.bisect_left(at, m.start())
            if k < len(at) and at[k] < m.end():
                score = clause_score(self.grammar, [hits.get(w.start()) or (word_class(w.group()), 0.0) for w in SYMBOL.finditer(low, m.start(), m.end())])
                if score > 0:
                    out.append((m.start(), m.end(), score))
        return out

    def features(self, text: str | None) -> list[float]:
        scores = [s for _, _, s in self.clauses(text)]
        return [1.0, math.log1p(sum(scores)), max(scores, default=0.0) / MOST_WEIGHT, math.log1p(sum(s >= COUNTED for s in scores))]


def different(texts: list[str]) -> list[list[str]]:
    """The words of each text, of near copies only the first: texts that agree in one of three least shingle hashes."""
    seen, out, one = set(), [], {}
    for t in texts:
        words = [one.setdefault(w, w) for w in WORD.findall(t.lower())]
        shingles = {zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))}
        marks = {(k, min((h * a + k) & 0xFFFFFFFF for h in shingles)) for k, a in enumerate((1, 0x9E3779B1, 0x85EBCA6B))}
        if words and not marks & seen:
            out.append(words)
        seen |= marks
    return out


def in_new_contexts(texts: list[list[str]]) -> list[set[str]]:
    """The words of each text that stand somewhere between two neighbours neither of which they had in a text before: a
    passage that many texts share supports its words once. What was seen is kept as hashes."""
    seen: set[int] = set()
    out = []
    for ws in texts:
        before, after = ([hash(p) for p in zip(x, y)] for x, y in ((["", *ws], ws), (ws, [*ws[1:], ""])))
        out.append({w for w, x, y in zip(ws, before, after) if x not in seen and ~y not in seen})
        seen.update(before)
        seen.update(~y for y in after)
    return out


def ratio(k: int, n: int, base: int, m: int) -> float:
    """Twice the log likelihood ratio of k in n texts against base in m."""
    both = (k + base) / (n + m)
    part = lambda x, of, p: x * math.log(x / of / p) if x else 0.0
    return 2 * (part(k, n, both) + part(n - k, n, 1 - both) + part(base, m, both) + part(m - base, m, 1 - both))


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and word beginnings with many different endings, that mark toxic documents, with log odds as weights.

    A beginning that only one word's texts support is no stem: its word is taken whole. Of stems that begin with each
    other the one least likely by chance stays, or the longest that is nearly as unlikely; words that begin with a stem
    of nearly their odds go."""
    bad, good = in_new_contexts(different(toxic)), [set(ws) for ws in different(clean)]
    forms = lambda w: [(w[:k], w[k:]) for k in STEM_LENGTHS if k <= len(w)]
    words = Counter(w for ws in bad for w in ws if len(w) >= 3)
    endings: dict[str, Counter] = defaultdict(Counter)
    for ws in bad:
        for w in ws:
            for f, e in forms(w):
                endings[f][e] += 1
    stems = Counter(f for ws in bad for f in {f for w in ws for f, _ in forms(w)})
    stems = {f: n for f, n in stems.items() if n >= LEAST_DOCS and len(endings[f]) >= LEAST_ENDINGS and 2 * max(endings[f].values()) <= sum(endings[f].values())}
    words = {w: n for w, n in words.items() if n >= LEAST_DOCS}
    word_base = Counter(w for ws in good for w in ws & words.keys())
    stem_base = Counter(f for ws in good for f in {f for w in ws for f, _ in forms(w)} & stems.keys())

    def strong(found: dict[str, int], base: Counter) -> dict[str, tuple[float, float]]:
        told = {f: (ratio(n, len(bad), base[f], len(good)), math.log((n + 0.5) / (len(bad) + 1)) - math.log((base[f] + 0.5) / (len(good) + 1))) for f, n in found.items()}
        return {f: x for f, x in told.items() if x[0] >= LEAST_RATIO and x[1] >= LEAST_ODDS}

    kept: dict[str, float] = {}
    found = strong(stems, stem_base)
    for f, (best, _) in sorted(found.items(), key=lambda y: (-y[1][0], y[0])):
        if not any(f.startswith(k) or k.startswith(f) for k in kept):
            f = max((g for g, (x, _) in found.items() if g.startswith(f) and x >= NEARLY * best), key=len)
            kept[f] = min(found[f][1], MOST_WEIGHT)
    whole = {w: min(odds, MOST_WEIGHT) for w, (_, odds) in strong(words, word_base).items() if not any(w.startswith(k) and x >= odds - 1 for k, x in kept.items())}
    return whole, kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> dict[int, list[str]]:
    """Whole texts by label, at most TOXIC_DOCS, CLEAN_DOCS and SAMPLE_BYTES of each, of rows that may be learned from;
    those with the least hash of the id, thinned by it before they are sorted."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).distinct()
    marks = marks.filter(~held_out("_id")).withColumn("_h", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "_id"), 11) / F.lit(float(1 << 53)))
    counts = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    out = {}
    for y, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        few = marks.filter((F.col("_y") == y) & (F.col("_h") < min(1.0, 2.0 * most / max(1, counts.get(y, 0))))).orderBy("_h", "_id").limit(most)
        rows = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(few), docs[id_col] == few["_id"]).select("_h", F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_t"))
        upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("_h", "_t").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.orderBy("_h", "_t").limit(most).withColumn("_upto", upto).filter(F.col("_upto") <= SAMPLE_BYTES)  # of so many rows
        out[y] = [t for _, t in sorted((r["_h"], r["text"]) for r in rows.select("_h", "text").collect())]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The lexicon, then the logistic model over clause scores, from the sample."""
    texts = sample(docs, labels, id_col, text_col)
    n = len(texts[0]) + len(texts[1])
    if not texts[0] or not texts[1]:
        return Model(prior=len(texts[1]) / n if n else 0.0)
    model = Model(*learn_lexicon(texts[1], texts[0]))
    scorer = Scorer(model.words, model.stems)
    x = np.array([scorer.features(t) for y in (0, 1) for t in texts[y]])
    y = np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])])
    model.coef = logistic(x, y)
    return model


def score_text(model: Model, scorer: Scorer, text: str | None) -> float:
    if not model.coef.any():
        return model.prior
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(model.coef @ scorer.features(text))))))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems)
        for batch in batches:
            scores = [score_text(model, scorer, t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=_OUT)

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its text alone."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def matched_clauses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, score``: each matched clause of each text, by places in the lower-cased text."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<start: int, end: int, score: double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.words, model.stems)
        for texts in parts:
            yield pd.Series([[{"start": a, "end": b, "score": s} for a, b, s in scorer.clauses(t)] for t in texts])

    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(run(F.col(text_col))).alias("_c"))
    return each.select("doc_id", "_c.start", "_c.end", "_c.score")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, all columns kept."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems)
        for batch in batches:
            yield batch.filter(pa.array([score_text(model, scorer, t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
