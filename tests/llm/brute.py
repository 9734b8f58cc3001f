"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, window):
    """docs: (doc_id, text) rows -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [((t or "").encode(), i) for i, t in docs]
    seen = defaultdict(int)
    for b, _ in raw:
        for s in range(len(b) - window + 1):
            seen[b[s : s + window]] += 1
    out = []
    for b, i in raw:
        drop = [False] * len(b)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                drop[s : s + window] = [True] * window
        spans = sum(d and not (k and drop[k - 1]) for k, d in enumerate(drop))
        out.append((i, len(b), sum(drop), spans, hashlib.sha256(bytes(x for x, d in zip(b, drop, strict=True) if not d)).hexdigest()))
    return out


def earlier_words(docs, window):
    seen, out = {}, []
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, w in sorted(rows, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    for i, w in rows:
        drop = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] != (i, s):
                drop[s : s + window] = [True] * window
        kept = " ".join(x for x, d in zip(w, drop, strict=True) if not d)
        out.append((i, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def components(nodes, linked):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {n: find(n) for n in nodes}
