"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}


def ws_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def near_classes(rows, k=5, percent=75):
    """[(id, set size, smallest id reachable)] of (id, text) rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = ws_words(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def passages(rows, size=50):
    """{(id, start, end)}: maximal runs of words covered by windows of ``size`` words that occur twice."""
    texts = {i: ws_words(t) for i, t in rows}
    count = defaultdict(int)
    for w in texts.values():
        for k in range(len(w) - size + 1):
            count[tuple(w[k:k + size])] += 1
    out = set()
    for i, w in texts.items():
        run = None
        for k in range(len(w) - size + 1):
            if count[tuple(w[k:k + size])] > 1:
                if run and k <= run[1]:
                    run[1] = k + size
                else:
                    if run:
                        out.add((i, *run))
                    run = [k, k + size]
        if run:
            out.add((i, *run))
    return out


def plain_words(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def infix_distance(pattern, text):
    """Least edit distance of ``pattern`` to any run of ``text``: the whole distance table, a row at a time."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys([*pattern, *text]))}
    t = np.array([numbers[w] for w in text], np.int64)
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, p in enumerate(pattern):
        new = np.concatenate(([i + 1], np.minimum(row[:-1] + (t != numbers[p]), row[1:] + 1)))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def leaks(docs, items, share=0.3, least=8):
    """{(doc, item)}: some run of the document is within ``share`` edits of the item; short items are held as they are."""
    out = set()
    plain = [(i, plain_words(t)) for i, t in items]
    for d, t in docs:
        text = plain_words(t)
        for i, p in plain:
            if p and infix_distance(p, text) <= (int(share * len(p)) if len(p) >= least else 0):
                out.add((d, i))
    return out


def pagerank(seeds, edges, damping=0.85, rounds=200):
    """(1 - damping) * seed + damping * what neighbours pass on, by weight."""
    out = defaultdict(float)
    for a, _, w in edges:
        out[a] += w
    rank = dict(seeds)
    for _ in range(rounds):
        new = defaultdict(float, {h: (1 - damping) * s for h, s in seeds.items()})
        for a, b, w in edges:
            new[b] += damping * rank.get(a, 0.0) * w / out[a]
        rank = new
    return rank
