"""Plain versions of the operators, for small tables."""

import hashlib


def raw(text):
    return (text or "").encode()


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in raw(text))


def exact(rows):
    """(doc_id, text) rows to sorted (doc_id, keep_id, group_size, text_sha256)."""
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    keep = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, keep[fold(t)], len(groups[fold(t)]), hashlib.sha256(fold(t)).hexdigest()) for d, t in rows), key=str)


def word_runs(rows, length):
    first = {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in ordered:
        w = raw(t).split()
        for a in range(len(w) - length + 1):
            first.setdefault(tuple(w[a : a + length]), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        w = raw(t).split()
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a : a + length])] < (float("inf") if d is None else d):
                gone[a : a + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def byte_runs(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        b = raw(t)
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            k = b[a : a + length]
            if k in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for a in range(len(b)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingles(text, k):
    w = fold(text).split()
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


class Forest:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in rows]
    forest = Forest(d for d, _ in sets)
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and den * len(s & u) >= num * len(s | u):
                forest.join(a, b)
    return sorted((d, len(s), forest.find(d)) for d, s in sets)
