import re

import pytest

from edgetide.llm import license_join as j


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text):
    w, places, base, labels, score = words(text), [], set(), set(), 0.0
    for phrase, label in j.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += hits
        if hits:
            base.add(label)
    for label, template in j.TEMPLATES:
        own = set(words(template))
        span = j.span(len(words(template)))
        for i in range(len(w)):
            share = len(own & set(w[i:i + span])) / len(own) if w[i] in own else 0
            if share >= j.CONTAINMENT - 1e-9:
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else score)


def check(docs):
    got = sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word or -1, r.last_word or -1, r.base_labels, r.labels, round(r.score, 9)) for r in j.scan(docs).collect())
    want = []
    for r in docs.collect():
        n, places, first, last, base, labels, score = brute(r.text)
        want.append((r.doc_id or -1, n, places, first or -1, last or -1, base, labels, round(score, 9)))
    assert got == sorted(want)


TEXTS = [
    "Released under the MIT License.", "MIT\nlicense and mit-license, MIT LICENSE; omit licenses", "cc by cc by CC\tBY", "acc by cc bye",
    "GNU General Public License gnu general public license", "x " * 5000 + "apache license",
    "Licenced under the Apache-2.0 license version 0", "under terms of the GNU Lesser General Public License as published by the Free Software",
    "Redistribution and use in source and binary forms with or without modification are permitted provided the following conditions are met",
    "licensed under cc by nc 4 0", "0.4 NC BY CC under Licensed", "this work is under a creative commons attribution 4 0 license", "ÉMIT license émit license mit éicense",
    "", None, "nothing here", "the of and in or a to", "Released under the MIT License.",
]


def test_texts_equal_brute_force(spark):
    check(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))


def test_whole_table_equals_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs)
    assert j.scan(no_docs).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.6, 1.0])
def test_other_thresholds(spark, monkeypatch, threshold):
    monkeypatch.setattr(j, "CONTAINMENT", threshold)
    check(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"))


def wrapped(template, at):
    w = template.split()
    return " * " + " ".join(w[:at]) + "\n * " + " ".join(w[at:])


def test_notices_are_found_wherever_lines_break(spark):
    mit, bsd = (next(t for label, t in j.TEMPLATES if label == name and len(t) > 60) for name in ("mit", "bsd-3-clause"))
    inserted = mit.replace("any person", "any kind of person").replace("this software", "all of this software")
    texts = [
        "Copyright\n\n" + wrapped(mit, 13) + ", to deal\nin it", wrapped(bsd, 10), bsd.replace(" ", "\r\n"), "x " * 3000 + "\n" + wrapped(bsd.upper(), 10) + "\ny" * 3000,
        "\n".join(reversed(bsd.split())), inserted, wrapped(inserted, 12), "\n".join(bsd.split()[:16]), "\n".join(bsd.split()[:17]),
        " ".join(" a b c d".join(bsd.split())), "\u212aopyright " + mit.replace("charge", "CHARGE"), mit.replace("k", "\u212a").replace("copy", "\u0130"),
        *("x " * (j.STRETCH - k) + mit + " y" * 900 for k in (0, 1, 7, 20, 25, 30)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    got = {r.doc_id: r.labels for r in j.scan(df).collect()}
    assert [got[i] for i in range(9)] == ["mit", *["bsd-3-clause"] * 4, "mit", "mit", "", "bsd-3-clause"]
    assert {got[i] for i in range(12, 18)} == {"mit"}


def test_scattered_words_are_no_block(spark):
    mit = next(t for label, t in j.TEMPLATES if label == "mit" and len(t) > 60)
    df = spark.createDataFrame([(1, " and more words ".join(mit.split())), (2, "any " * 3000 + mit)], "doc_id long, text string")
    check(df)
    assert {r.doc_id: r.labels for r in j.scan(df).collect()} == {1: "", 2: "mit"}
