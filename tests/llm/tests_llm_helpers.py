from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets, root = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in texts}


def brute_dedup_texts(texts, k=13):
    first = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = {}
    for i, t in texts.items():
        w, gone = WORD.findall(t or ""), set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    return out
