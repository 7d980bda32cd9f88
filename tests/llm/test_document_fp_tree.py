import math
import random
import re

import numpy as np
import pytest

from edgetide.llm import document_fp_tree as fp

FOLDED = str.maketrans(fp.UPPER, fp.LOWER)


def terms(text):
    return re.findall(fp.TERM, (text or "").translate(FOLDED))


def brute(docs, items, k=fp.TOP):
    """Every document scored for every item: (item_id, rank, doc_id, score), sorted."""
    counted = [(doc_id, terms(text)) for doc_id, text in docs]
    counted = [(doc_id, t) for doc_id, t in counted if t]
    n, total = len(counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, t in counted:
            m = 50 + (50 * len(t) * n) // total
            score = 0
            for x in set(terms(text)):
                tf = t.count(x)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        found += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(found, key=str)


def frame(spark, rows, name):
    return spark.createDataFrame([(*r, "q", 1, 2, 3, 4) for r in rows], f"{name} long, text string, terms string, n int, item int, score int, part int")


def search(spark, docs, items, **options):
    return sorted((tuple(r) for r in fp.search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), **options).collect()), key=str)


def corpus(seed, size):
    """Documents whose words fall off like those of a language, with copies and ties."""
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(dice.choices(words, weights, k=dice.randint(1, 40)))) for i in range(size)]
    docs += [(size + i, docs[dice.randrange(size // 4)][1]) for i in range(size // 2)]
    items = [(i, " ".join(dice.choices(words, k=dice.randint(1, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50])
def test_against_brute_force(spark, k, monkeypatch):
    docs, items = corpus(k, 300)
    assert search(spark, docs, items, k=k) == brute(docs, items, k)


def test_small_trees_small_leaves_and_blocks_change_nothing(spark):
    docs, items = corpus(9, 200)
    assert search(spark, docs, items, k=3, block_terms=20) == brute(docs, items, 3)


def tree_of(docs, items, tree_rows):
    """A task's work by hand: trees over ``tree_rows`` documents each, and the best of all."""
    counted = [(doc_id, terms(t)) for doc_id, t in docs]
    df = {}
    for _, t in counted:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    order = {t: i for i, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    weights = np.array([fp.weight(len(docs), df[t]) for t in order])
    total = sum(len(t) for _, t in counted)
    trees = []
    for at in range(0, len(counted), tree_rows):
        part = counted[at:at + tree_rows]
        own = [sorted({order[x] for x in t}) for _, t in part]
        trees.append(fp.Tree.build(
            np.array([i for i, _ in part]), np.array([50 + 50 * len(t) * len(docs) // total for _, t in part]),
            np.array([len(o) for o in own]), np.concatenate(own),
            np.concatenate([[t.count(x) for x in sorted(set(t), key=order.get)] for _, t in part]), weights))
    return trees, [np.array(sorted({order[x] for x in terms(t)} if terms(t) else []), dtype=np.int64) for _, t in items], len(order)


@pytest.mark.parametrize("leaf", [1, 4, 10_000])
def test_search_of_trees(leaf, monkeypatch):
    monkeypatch.setattr(fp, "LEAF", leaf)
    docs, items = corpus(11, 240)
    items = [(i, " ".join(t for t in text.split() if any(t in d.split() for _, d in docs))) for i, text in items]
    for tree_rows in (50, 1000):
        trees, wanted, size = tree_of(docs, items, tree_rows)
        found = []
        for (item_id, _), item in zip(items, wanted):
            best, mine = fp.Best(7), np.zeros(size, dtype=bool)
            mine[item] = True
            for tree in trees:
                tree.search(item, mine, best)
            ranked = sorted(zip((-best.found).tolist(), best.ids.tolist()))
            found += [(item_id, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(ranked, 1)]
        assert sorted(found, key=str) == brute(docs, items, 7)


def test_bounds_spare_work(monkeypatch):
    """A selective item scores a small part of the documents exactly."""
    docs, _ = corpus(12, 4000)
    trees, wanted, size = tree_of(docs, [(0, "w50 w55 w0")], 10_000)
    scored = []
    scores = fp.Tree.scores
    monkeypatch.setattr(fp.Tree, "scores", lambda self, lo, hi, mine: scored.append(hi - lo) or scores(self, lo, hi, mine))
    mine = np.zeros(size, dtype=bool)
    mine[wanted[0]] = True
    trees[0].search(wanted[0], mine, fp.Best(5))
    assert sum(scored) < len(docs) / 4


def test_edge_cases(spark):
    docs = [(1, "Alpha beta"), (1, "Alpha beta"), (None, "alpha BETA"), (2, None), (3, ""), (4, "... --- \n"), (5, "Äther äther gamma"),
            (6, "x" * 100_000 + " beta"), (7, " ".join(f"long{i}" for i in range(50_000)) + " alpha")]
    items = [(1, "alpha, beta!"), (1, "alpha, beta!"), (2, None), (3, ""), (4, "Äther"), (5, "äther"), (None, "gamma"), (6, "nowhere")]
    assert search(spark, docs, items) == brute(docs, items)
    assert search(spark, [], items) == [] and search(spark, docs, []) == [] and search(spark, [(1, None)], items) == []
