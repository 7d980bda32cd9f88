from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import classes, shingles, similarity
from pyspark.sql import functions as F

from edgetide.llm import prob_minhash as p
from edgetide.llm.common import Scratch


def grouped(rows):
    found = defaultdict(set)
    for i, r in enumerate(rows):
        found[r].add(i)
    return {frozenset(x) for x in found.values()}


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    got = {(r.doc_id): r for r in p.near_duplicates(docs).collect()}
    want = classes([r.text for r in rows])
    by_id = grouped([got[r.doc_id].class_id for r in rows])
    assert by_id == want
    sizes = {i: len(c) for c in want for i in c}
    assert all(got[r.doc_id].class_rows == sizes[i] for i, r in enumerate(rows))


def test_classes_equal_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def family(n, seed=0, words=120):
    """Texts that drift away from a first one word by word: neighbours are similar, the ends are not."""
    rng = np.random.default_rng(seed)
    text = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    for _ in range(n):
        yield " ".join(text)
        for at in rng.integers(0, words, 1):
            text[at] = f"w{rng.integers(0, 10**6)}"


def test_chains_and_blocks(spark, monkeypatch):
    texts = [t for seed in range(4) for t in family(30, seed)] + [f"lonely text number {i} stands here alone today" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(p, "BLOCK", 7)
    check(docs)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), None)
    a = (a[0], rng.integers(1, 6, len(a[0])))
    b = (a[0][60:], np.maximum(1, a[1][60:] + rng.integers(-1, 2, len(a[0]) - 60)))
    want, _ = p.probability_jaccard(a, b)
    agree = []
    for k in range(30):  # other hashes, the same sets
        x, y = (( p.mix64(h + np.uint64(k)), w) for h, w in (a, b))
        one, two = p.signatures([x, y])
        agree.append((one == two).mean())
    assert np.mean(agree) == pytest.approx(want, abs=0.03)


def test_similarity_equals_brute_force():
    one, two = "a b c d e f g a b c d e h i j", "a b c d e f g h a b c d e h i j"
    ours = p.probability_jaccard(p.shingles(one.encode()), p.shingles(two.encode()))
    assert max(ours) == pytest.approx(similarity(shingles(one), shingles(two)))
    text = "x  y\tz\n" * 5
    hashes, counts = p.shingles(text.encode())
    assert sorted(counts.tolist()) == sorted(Counter(shingles(text)).values())


def test_edge_rows(edge_docs, no_docs):
    got = p.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_class = Counter(r.class_id for r in got)
    assert by_class[1] == 5 and by_class[3] == 2 and by_class[4] == by_class[5] == by_class[6] == by_class[7] == 1
    kept = p.first_of_each(edge_docs)
    assert kept.schema == edge_docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7]
    assert p.near_duplicates(no_docs).count() == 0 and p.first_of_each(no_docs).count() == 0


def test_repeated_passages_do_not_hide_plain_similarity(spark):
    texts = []
    for seed in range(8):
        w = [f"s{seed}w{i}" for i in range(200)]
        texts += [" ".join(w + w[-20:] * more) for more in (0, 10, 20)]
    texts += ["t " * 40 + " ".join(f"u{i}" for i in range(100)), "t " * 400 + " ".join(f"u{i}" for i in range(100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)
    first, last = (p.shingles(texts[i].encode()) for i in (0, 2))
    weighted, plain = p.probability_jaccard(first, last)
    assert weighted < 0.5 and plain >= 0.8 and len({r.class_id for r in p.near_duplicates(docs).collect()}) == 9


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    chain = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["class"] for r in p.components(nodes, chain, Scratch(spark), "chain").collect()} == {0}
    monkeypatch.setattr(p, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="rounds"):
        p.components(nodes, chain, Scratch(spark), "chain")
