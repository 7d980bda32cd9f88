import random
import zlib

import pytest
from pyspark.sql import functions as F

from edgetide.llm import compression_toxicity as c


def corpus(n, share=0.2, seed=4):
    rng = random.Random(seed)
    parts = ["an", "er", "tion", "the", "ing", "re", "ha", "on", "ble", "st", "ou"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randint(10, 150))], rng.random() < share
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["zqidiox", "kvlossex", "grumpfel"]))
        rows.append((i, " ".join(w), "x", 1.5))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(1500)
    return (spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    model = c.fit(docs, labels)
    got = {r.doc_id: r.score for r in c.score(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in docs.filter(c.held_out(F.col("doc_id"))).collect()} == set(held)
    toxic, plain = [got[i] for i in held if truth[i]], [got[i] for i in held if not truth[i]]
    assert sum(s >= 0.5 for s in toxic) >= 0.9 * len(toxic) and sum(s >= 0.5 for s in plain) <= 0.03 * len(plain)
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_labels_are_not_learnt(tables):
    docs, labels, _ = tables
    turned = labels.withColumn("toxic", F.when(c.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = c.fit(docs, labels), c.fit(docs, turned)
    assert one.toxic == two.toxic and one.ordinary == two.ordinary and (one.weights == two.weights).all()


def test_edge_rows(tables, edge_docs, no_docs, spark):
    docs, labels, _ = tables
    model = c.fit(docs, labels)
    got = c.score(edge_docs, model).collect()
    assert len(got) == edge_docs.count() and all(r.score < 0.5 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5, 9)}) == 1
    assert c.score(no_docs, model).count() == 0
    none = labels.filter("toxic = 0")
    assert {r.score for r in c.score(docs, c.fit(docs, none)).collect()} == {0.0}
    assert {r.score for r in c.score(docs, c.fit(docs, labels.filter("toxic = 1"))).collect()} == {0.49}
    assert c.fit(no_docs, labels.limit(0)) == 0.0


def test_a_toxic_word_late_in_a_long_text_counts(tables, spark):
    docs, labels, _ = tables
    model = c.fit(docs, labels)
    long = " ".join(["the", "anreing", "onble"] * 20_000)
    texts = spark.createDataFrame([(1, long), (2, long + " zqidiox grumpfel")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in c.score(texts, model).collect()}
    assert got[2] > got[1]
