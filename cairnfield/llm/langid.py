"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

A text is cut into stretches of ``STRETCH`` bytes; two gated recurrent passes, forth and back, give each byte a
distribution over the languages, and a document's probabilities are the mean over its letter bytes. The network is
trained in numpy by backpropagation through time (Adam) on a bounded, hash-chosen sample of labelled documents.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when no labelled
document exists. Whole texts are read. Repeated rows are labelled each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage, small_side, stage_table

UND = "und"
STRETCH = 64
HIDDEN = 8
#: The training sample: documents of each language, and bytes of their whole texts, at most.
DOCS_PER_LANGUAGE, LANGUAGE_BYTES = 300, 4 << 20
STEPS = 160
BATCH = 256
RATE = 0.02
SEED = 7
#: Stretches labelled at a time.
BLOCK = 2048

#: 1 for bytes of letters: ASCII letters, and all bytes of other characters.
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)], np.float32)


def held_out(id_col: str = "doc_id"):
    """Rows no model may learn from: crc32 of the id's text is divisible by 5. False for a null id, whose remainder is
    not known: such rows are not learned from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """Per direction: ``table`` (3H, 256), what a byte adds to the gates (reset, update, candidate); ``u`` (3H, H)."""

    languages: list[str]
    table: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray  # (C, 2H)
    bias: np.ndarray  # (C, 1)

    def params(self) -> list[np.ndarray]:
        return [*self.table, *self.u, self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
    h, c = hidden, len(languages)
    return Model(languages, [normal(0.3, 3 * h, 256) for _ in "fb"], [normal(0.3, 3 * h, h) for _ in "fb"], normal(0.3, c, 2 * h), np.zeros((c, 1), np.float32))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in (-1, 1): the candidate's activation; a sixth of the time of tanh."""
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    """The same, in (0, 1): the gates' activation."""
    return 0.5 * squash(x) + 0.5


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def _forward(table: np.ndarray, u: np.ndarray, x: np.ndarray) -> list[tuple]:
    """States of a pass over x (T, B), in its order: (h before, reset, update, candidate, u_n h, h) per step."""
    n = u.shape[1]
    h, steps = np.zeros((n, x.shape[1]), np.float32), []
    for row in x:
        gates, inner = table[:, row], u @ h
        r = gate(gates[:n] + inner[:n])
        z = gate(gates[n : 2 * n] + inner[n : 2 * n])
        c = squash(gates[2 * n :] + r * inner[2 * n :])
        new = c + z * (h - c)
        steps.append((h, r, z, c, inner[2 * n :], new))
        h = new
    return steps


def _backward(table: np.ndarray, u: np.ndarray, x: np.ndarray, steps: list[tuple], d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of (table, u), through time; d_out (T, H, B) in the pass's order."""
    n = u.shape[1]
    d_u, d_h = np.zeros_like(u), np.zeros_like(d_out[0])
    d_gates = np.empty((len(x), 3 * n, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, r, z, c, inner, _ = steps[t]
        d_h = d_h + d_out[t]
        d_c = d_h * (1 - z) * (1 - np.abs(c)) ** 2
        d_r = d_c * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_z = d_h * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_gates[t] = np.concatenate([d_r, d_z, d_c])
        d_inner = np.concatenate([d_r, d_z, d_c * r])
        d_u += d_inner @ h.T
        d_h = d_h * z + u.T @ d_inner
    hot = np.zeros((x.size, 256), np.float32)
    hot[np.arange(x.size), x.ravel()] = 1
    return d_gates.transpose(1, 0, 2).reshape(3 * n, -1) @ hot, d_u


def gradients(m: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the letter positions of x (T, B; labels y), and the gradients of ``m.params()``."""
    forth, back = _forward(m.table[0], m.u[0], x), _forward(m.table[1], m.u[1], x[::-1])
    states = np.stack([np.concatenate([f[5], b[5]]) for f, b in zip(forth, back[::-1])])
    p = softmax((m.out @ states + m.bias).transpose(1, 0, 2))  # (C, T, B)
    weight = LETTER[x] / max(1.0, float(LETTER[x].sum()))
    loss = -float((np.log(np.maximum(p[y, :, np.arange(len(y))].T, 1e-12)) * weight).sum())
    d = p.copy()
    d[y, :, np.arange(len(y))] -= 1
    d = (d * weight).transpose(1, 0, 2)  # (T, C, B)
    d_states = m.out.T @ d
    n = m.u[0].shape[1]
    g_f = _backward(m.table[0], m.u[0], x, forth, d_states[:, :n])
    g_b = _backward(m.table[1], m.u[1], x[::-1], back, d_states[::-1, n:])
    d_out = np.einsum("tcb,thb->ch", d, states)
    return loss, [g_f[0], g_b[0], g_f[1], g_b[1], d_out, d.sum(axis=(0, 2))[:, None]]


def train(stretches: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = SEED) -> Model:
    """``stretches`` (N, T) of bytes with language numbers ``labels``; each step takes as many of each language."""
    m, rng = fresh(languages, seed=seed), np.random.default_rng(seed)
    by = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(i, max(1, BATCH // len(by))) for i in by])
        _, grads = gradients(m, np.ascontiguousarray(stretches[at].T), labels[at])
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, a, b in zip(m.params(), grads, first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def cut(data: np.ndarray, lengths: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(stretches (N, size), padded with 0; number of stretches of each text) of texts laid end to end in ``data``."""
    counts = -(-lengths // size)
    out = np.zeros(int(counts.sum()) * size, np.uint8)
    at = to = 0
    for n, k in zip(lengths.tolist(), counts.tolist()):
        out[to : to + n] = data[at : at + n]
        at, to = at + n, to + k * size
    return out.reshape(-1, size), counts


class Labeller:
    """The trained network, laid out for labelling many stretches at a time."""

    def __init__(self, m: Model) -> None:
        n = m.u[0].shape[1]
        self.n, self.table, self.u = n, m.table, m.u
        self.out, self.bias = m.out, m.bias

    def _pass(self, d: int, x: np.ndarray) -> np.ndarray:
        n, b = self.n, x.shape[1]
        states = np.empty((len(x), n, b), np.float32)
        h, gates, inner, size = np.zeros((n, b), np.float32), np.empty((3 * n, b), np.float32), np.empty((3 * n, b), np.float32), np.empty((2 * n, b), np.float32)
        rz, c = gates[: 2 * n], gates[2 * n :]
        r, z = gates[:n], gates[n : 2 * n]
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            np.take(self.table[d], x[t], axis=1, out=gates, mode="clip")
            np.matmul(self.u[d], h, out=inner)
            rz += inner[: 2 * n]
            np.abs(rz, out=size)
            size += 1
            rz /= size
            rz *= 0.5
            rz += 0.5
            r *= inner[2 * n :]
            c += r
            np.abs(c, out=size[:n])
            size[:n] += 1
            c /= size[:n]
            new = states[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            h = new
        return states

    def positions(self, stretches: np.ndarray) -> np.ndarray:
        """(T, C, N): the distribution over the languages at every position."""
        x = np.ascontiguousarray(stretches.T)
        logits = self.out[:, : self.n] @ self._pass(0, x)
        logits += self.out[:, self.n :] @ self._pass(1, x)
        logits += self.bias
        np.exp(logits - logits.max(axis=1, keepdims=True), out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(texts, C): mean distribution over each text's letter bytes; zeros for a text without any."""
        stretches, counts = cut(data, lengths)
        sums, weights = np.zeros((len(stretches), len(self.bias))), np.zeros(len(stretches))
        for lo in range(0, len(stretches), BLOCK):
            part = stretches[lo : lo + BLOCK]
            w = LETTER[part].T  # (T, N)
            sums[lo : lo + BLOCK] = np.einsum("tcn,tn->nc", self.positions(part), w)
            weights[lo : lo + BLOCK] = w.sum(axis=0)
        doc = np.repeat(np.arange(len(lengths)), counts)
        total = np.stack([np.bincount(doc, s, len(lengths)) for s in sums.T], axis=1)
        return total / np.maximum(np.bincount(doc, weights, len(lengths)), 1)[:, None]


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(lang, whole text) of at most DOCS_PER_LANGUAGE labelled documents and LANGUAGE_BYTES of each language that may be
    learned from, those with the least hashes; thinned by hash before they are ranked, so no large group is sorted."""
    known = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.filter(known & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"))
    counts = stage_table(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    shares = small_side(counts.select("lang", (F.lit(2.0 * DOCS_PER_LANGUAGE) / F.col("n")).alias("share")), counts.staged_rows, 64)
    thin = rows.join(shares, "lang").filter((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.col("share"))
    ranked = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    few = thin.withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= DOCS_PER_LANGUAGE)
    best = few.withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= LANGUAGE_BYTES)
    found = sorted((r["lang"], r["text"]) for r in best.select("lang", "text").collect())
    drop_stage(counts)
    return found


def fit(docs: DataFrame, **columns: str) -> Model | None:
    """Trains on all stretches with a letter of the sample; None if there is none."""
    rows = [(k, t.encode()) for k, t in sample(docs, **columns)]
    known = sorted({k for k, t in rows if LETTER[np.frombuffer(t, np.uint8)].any()})
    if not known:
        return None
    parts, labels = [], []
    for number, language in enumerate(known):
        texts = [t for k, t in rows if k == language]
        s, _ = cut(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        parts.append(s[LETTER[s].any(axis=1)])
        labels.append(np.full(len(parts[-1]), number))
    return train(np.concatenate(parts), np.concatenate(labels), known)


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _labels(model: Model | None):
    """A function from a column of texts to (languages, scores)."""
    labeller = Labeller(model) if model else None

    def label(column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.to_pylist()
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not labeller or not lettered.any():
            return [UND] * len(texts), np.zeros(len(texts))
        encoded = [t.encode() if t else b"" for t in texts]
        p = labeller.pooled(np.frombuffer(b"".join(encoded), np.uint8), np.array([len(t) for t in encoded]))
        langs = [model.languages[k] if ok else UND for k, ok in zip(p.argmax(axis=1), lettered)]
        return langs, np.where(lettered, np.minimum(p.max(axis=1), 1.0), 0.0)

    return label


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labels(model)
        for batch in batches:
            langs, scores = label(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], schema=_OUT)

    return run


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns kept: those labelled ``und`` go."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _labels(model)
        for batch in batches:
            yield batch.filter(pa.array([k != UND for k in label(batch.column(at))[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
