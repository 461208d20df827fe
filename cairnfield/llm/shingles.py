"""Word shingles of whole texts as sets of 64-bit hashes, computed a batch at a time in numpy.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A set holds the hashes of a text's distinct
5-word shingles; with fewer words, of the whole sequence; without words it is empty. Memory follows the largest text,
not the batch: bytes are hashed ``PART`` at a time, a word being the least part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
PART = 1 << 19
#: Texts are hashed together up to so many bytes.
TOGETHER = 1 << 20

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = {_BASE: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, PART) + 1, base)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial in the word's bytes modulo 2^64, mixed with its length."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + PART, side="right")))
        part = LOWER[data[lo : ends[to - 1]]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(_BASE, len(part)), out=sums[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        h = (sums[b] - sums[a]) * powers(_BACK, len(part))[a]
        out[at:to] = mix(h ^ ((b - a).astype(np.uint64) * _BASE))
        at = to
    return out


def _sequences(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences that begin at ``first``."""
    h = np.full(len(first), k, np.uint64)
    for i in range(k):
        h = mix(h * _BASE + words[first + i])
    return h


def sets_of(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text; texts lie between successive ``bounds`` of ``data``."""
    n = len(bounds) - 1
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    start[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = word_hashes(data, starts, ends)
    upto = np.searchsorted(starts, bounds)
    counts = np.diff(upto)
    doc = np.repeat(np.arange(n), counts)
    long = np.flatnonzero(doc[: len(doc) - WORDS + 1] == doc[WORDS - 1 :]) if len(doc) >= WORDS else np.empty(0, np.int64)
    hashes = _sequences(h, long, WORDS)
    cuts = np.searchsorted(long, upto)
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    for k in range(1, WORDS):
        for d in np.flatnonzero(counts == k):
            out[d] = _sequences(h, upto[d : d + 1], k)
    return out


def batch_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text of a string column, in order; a null text has none."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, side="right")) - 1)
        yield from sets_of(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
