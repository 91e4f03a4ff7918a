"""Plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def cut_repeats(rows, size):
    """(id, text) rows -> per row (words, words removed, kept words)."""
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key not in first or order(i) < order(first[key]):
                first[key] = i
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if order(first[tuple(w[k : k + size])]) < order(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, size):
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(rows, size, percent):
    """(id, text) rows -> id -> smallest id reached by links."""
    sets = [(i, shingles(text, size)) for i, text in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[at + 1 :]:
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def best_fit(pieces, capacity, per_source):
    """(size, source, cluster) pieces, largest first -> bin numbers, by looking at every bin."""
    bins = []
    out = []
    for size, source, cluster in pieces:
        fit = [
            (b["room"], n)
            for n, b in enumerate(bins)
            if b["room"] >= size and cluster not in b["clusters"] and b["sources"][source] < per_source
        ]
        n = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"room": capacity, "clusters": set(), "sources": Counter()})
        bins[n]["room"] -= size
        bins[n]["clusters"].add(cluster)
        bins[n]["sources"][source] += 1
        out.append(n)
    return out


def jaccard(a, b):
    """Generalised Jaccard similarity of the word counts of two texts."""
    x, y = Counter(words(a)), Counter(words(b))
    top = sum(max(x[k], y[k]) for k in x | y)
    return sum(min(x[k], y[k]) for k in x) / top if top else 1.0
