"""Brute-force n-gram components: all sets, counted through one inverted list."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    """(doc_id, set size, least id reachable) of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    nodes = list(dict.fromkeys(s for _, s in sets if s))
    parent = list(range(len(nodes)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    lists = defaultdict(list)
    for k, s in enumerate(nodes):
        common = Counter(x for g in s for x in lists[g])
        for x, n in common.items():
            if 100 * n >= 75 * (len(s) + len(nodes[x]) - n):
                parent[find(k)] = find(x)
        for g in s:
            lists[g].append(k)
    number = {s: k for k, s in enumerate(nodes)}
    least = {}
    for i, s in sets:
        if s and i is not None:
            c = find(number[s])
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(find(number[s])) if s else i) for i, s in sets), key=str)
