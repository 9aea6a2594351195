"""Plain versions of the operators, for small inputs."""
from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def windows(items, n):
    return [tuple(items[i:i + n]) for i in range(len(items) - n + 1)]


def covered(items, n, hit):
    out = [False] * len(items)
    for i, g in enumerate(windows(items, n)):
        if hit(g):
            out[i:i + n] = [True] * n
    return out


def repeated(items, n):
    grams = windows(items, n)
    return covered(items, n, lambda g: grams.count(g) > 1)


def remove_repeats(docs, n):
    """docs: (id, text); returns kept words by position of the row."""
    last = float("inf")
    first = {}
    for doc_id, text in docs:
        for g in windows(words(text), n):
            first[g] = min(first.get(g, last), last if doc_id is None else doc_id)
    out = []
    for doc_id, text in docs:
        own = last if doc_id is None else doc_id
        gone = covered(words(text), n, lambda g: first[g] < own)
        out.append([w for w, x in zip(words(text), gone, strict=True) if not x])
    return out


def shingle_set(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set(windows(w, n)) if len(w) >= n else {tuple(w)} if w else set()


def near_components(docs, n, percent):
    sets = {d: shingle_set(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * both >= percent * union:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def vocabulary(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 6))) for _ in range(n)]


def family(seed, copies, size, edits):
    """One text and copies of copies of it, each with some words replaced."""
    r, v = random.Random(seed), vocabulary(300, seed)
    texts = [[r.choice(v) for _ in range(size)]]
    for _ in range(copies):
        w = list(r.choice(texts))
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice(v)
        texts.append(w)
    return [" ".join(t) for t in texts]
