"""Plain Python forms of what the operators compute."""

import collections
import re
import zlib

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def words(t):
    return WORD.findall(lower(t))


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_groups(texts, k):
    """Least place of each text's group, by the sets' Jaccard similarity of 0.8 and more."""
    sets = [frozenset(shingles(t, k)) for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = collections.Counter((a, b) for own in by.values() for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def repeated_bytes(texts, length=200):
    """For each text which of its bytes lie in a string of that length that starts anywhere else too."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return raw, out


def leaks(texts, tests, p):
    """(text, test) pairs that overlap, by every diagonal."""
    from emberlake.llm import decontam

    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.int64)
    docs, asked = [code(t) for t in texts], [code(t) for t in tests]
    out = set()
    for j, t in enumerate(asked):
        need = p.similarity * min(len(t), p.least_words)
        for i, d in enumerate(docs):
            if not len(t) or not len(d):
                continue
            at, of = np.nonzero(d[:, None] == t[None, :])
            starts, n = np.unique(at - of, return_counts=True)
            if any(decontam.verify(d, t, int(s), p) for s in starts[n >= need]):
                out.add((i, j))
    return out
