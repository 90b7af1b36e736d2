"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(rows):
    """{id: (n_shingles, component)} of rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * (c := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def repeats(texts, window=35):
    """(n_words, n_removed, kept text) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contaminated(docs, items, width=13):
    words = lambda t: NORMAL.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def lines(rows, sites):
    """Kept text of each (id, text, source), ids distinct."""
    where, first = collections.defaultdict(set), {}
    name = lambda x: x.strip(" \t\r")
    for i, t, s in rows:
        for p, x in enumerate((t or "").split("\n")):
            if name(x):
                where[name(x)] |= {s} - {None}
                first[name(x)] = min(first.get(name(x), (i, p)), (i, p))
    out = {}
    for i, t, s in rows:
        out[i] = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not name(x) or len(where[name(x)]) < sites or first[name(x)] == (i, p))
    return out
