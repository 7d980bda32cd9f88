"""Plain Python versions of what the operators compute."""

import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines), "n_unique_words": len(set(w))}


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    """The larger of probability Jaccard and plain Jaccard."""
    every = set(a) | set(b)
    both = set(a) & set(b)
    if not both:
        return 0.0
    weighted = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in both)
    return max(weighted, len(both) / len(every))


def classes(texts):
    """Sets of row numbers whose texts are linked by equality or similarity, over any number of links."""
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags, owners = [shingles(t) for t in texts], defaultdict(set)
    for i, bag in enumerate(bags):
        for s in bag:
            owners[s].add(i)
    first = {}
    for i, t in enumerate(texts):
        parent[root(i)] = root(first.setdefault(t, i))
    pairs = {(i, j) for group in owners.values() for i in group for j in group if i < j}
    for i, j in pairs:
        if root(i) != root(j) and similarity(bags[i], bags[j]) >= 0.8 - 1e-12:
            parent[root(i)] = root(j)
    found = defaultdict(set)
    for i in range(len(texts)):
        found[root(i)].add(i)
    return {frozenset(x) for x in found.values()}


def targets(sizes):
    """Source sizes -> targets, resharing step by step what capped sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while rest > 1e-9 and open_:
        share = rest / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s]
        rest = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                rest += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def leaked(docs, items):
    """(doc_id, item_id) pairs for items without slots: most of an item's words lie under 4-word windows of the document
    whose shifts share a band."""
    token = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*")
    sizes, places, found = {}, {}, set()
    for item, text in items:
        w = token.findall((text or "").lower())
        sizes[item] = len(w)
        for i in range(len(w) - 3):
            places.setdefault(tuple(w[i:i + 4]), []).append((item, i))
    for doc_id, text in docs:
        w, bands = token.findall((text or "").lower()), {}
        for pos in range(len(w) - 3):
            for item, at in places.get(tuple(w[pos:pos + 4]), []):
                for band in ((pos - at) // 16, (pos - at) // 16 - 1):
                    bands.setdefault((item, band), set()).update(range(at, at + 4))
        found |= {(doc_id, item) for (item, _), own in bands.items() if len(own) >= 0.6 * sizes[item]}
    return found
