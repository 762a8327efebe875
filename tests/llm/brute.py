"""Plain versions of the contracts, for small inputs."""

import re
from collections import Counter

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = (text or "").encode().translate(UP).split()
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def components(docs):
    """doc_id -> (n_shingles, component) by all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(docs, least_chars=20, least_docs=3):
    """doc_id -> (n_lines, n_dropped, text)."""
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().translate(UP).decode()
    split = [(i, (t or "").split("\n")) for i, t in docs]
    holders = {}
    for i, ls in split:
        for k in {key(x) for x in ls}:
            if len(k) >= least_chars:
                holders.setdefault(k, []).append(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = {}
    for i, ls in split:
        kept = [x for x in ls if keeper.get(key(x), i) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def contamination(docs, items, size=13):
    """doc_id -> (n_words, n_hit, sorted items)."""
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(size, len(w))
        for x in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[x : x + k]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for x in range(len(w) - k + 1):
                if tuple(w[x : x + k]) in windows:
                    hit.update(range(x, x + k))
                    found |= windows[tuple(w[x : x + k])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def top(vectors, queries, k):
    """query -> [(id, score)] by all pairs."""
    import math

    ok = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in queries:
        if q in ok:
            scores = [(-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def counts(values):
    return Counter(values)
