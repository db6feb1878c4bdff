"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def shingles(text):
    w = words(text, r"[^\x20\x09-\x0D]+")
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_duplicates(rows):
    """rows: (doc_id, text) to {doc_id: (n, component, kept)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def hits(text, items, size=8):
    """n_words, n_hit, sorted ids of items with a window in the text."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = words(text, pattern)
    inside, found = set(), set()
    for item, said in items:
        t = words(said, pattern)
        for i in range(max(0, len(t) - size) + 1 if t else 0):
            window = t[i : i + size]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    inside.update(range(p, p + len(window)))
                    found.add(str(item))
    return len(w), len(inside), sorted(found)
