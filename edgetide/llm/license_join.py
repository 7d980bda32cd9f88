"""License scans by an exact set-similarity join (operator 10, DataFrame functions only).

A block is a run of neighbouring words of a text, wherever its line breaks are; a template is a known license sentence.
Both are sets of words. A block for a template of n words has at most n / ``CONTAINMENT`` words, so that a notice is
found with words replaced, left out or inserted in that proportion. Every block that contains at least ``CONTAINMENT``
of a template's different words is found. With c of them needed out of d, and words ordered by how rare they are in the
whole corpus, rarest first:

* prefix: such a block has one of the template's first d - c + 1 words, so only what is around these is looked at;
* length: it has c different words of templates or more;
* position: a first common word at place i of the template and j of the block leaves at most
  1 + min(words after i, words after j) common words, which must reach c.

What passes is verified word by word, for every block that holds the prefix word. Long texts are cut into overlapping
stretches, so that no row of the join is longer than a stretch. Besides, the places of the base phrases are counted in
every text.

Defined results: a null text counts as an empty one; texts of any length are scanned whole; of several blocks with the
same containment any gives the score; repeated rows are scanned one by one; a text without license has null places, empty
labels and a score of 0; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch, text_key

# Words of a text before and after A-Z are lower-cased (fixed by the result contract).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed by the result contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
CONTAINMENT = 0.8
# Words of a stretch, beside those that its blocks reach to on either side.
STRETCH = 512
# Sentences that licenses are known by, with the label of the license.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]


def lower_words(text: Column) -> Column:
    """The words of a text; those of ASCII characters only are lower-cased exactly in A-Z.

    Only the Kelvin sign has an ASCII letter as its lower case, so it becomes another letter before.
    """
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), F.lit(WORD), F.lit(0))


def span(length: int) -> int:
    """The longest block for a template of ``length`` words."""
    return math.ceil(length / CONTAINMENT - 1e-9)


def template_words(spark: SparkSession) -> DataFrame:
    """(template, label, length, word): the different words of each template, a table as small as the list above."""
    templates = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)],
                                      "template int, label string, text string")
    return templates.select("template", "label", F.size(lower_words(F.col("text"))).alias("length"),
                            F.explode(F.array_distinct(lower_words(F.col("text")))).alias("word"))


def ordered_templates(spark: SparkSession, docs: DataFrame) -> tuple[list[dict], list[str]]:
    """Each template with its words and the number of them that a block needs; all template words. Rarest first.

    The driver gets one count for each template word, however large the corpus is.
    """
    listed = template_words(spark).collect()
    vocabulary = sorted({r["word"] for r in listed})
    found = docs.select(F.explode(lower_words(F.coalesce("text", F.lit("")))).alias("word")).filter(
        F.col("word").isin(vocabulary)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in found.collect()}
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    templates = []
    for i, (label, _) in enumerate(TEMPLATES):
        own = {r["word"] for r in listed if r["template"] == i}
        templates.append({"template": i, "label": label, "words": [w for w in vocabulary if w in own],
                          "needed": math.ceil(CONTAINMENT * len(own) - 1e-9),
                          "span": span(next(r["length"] for r in listed if r["template"] == i))})
    return templates, vocabulary


def prefixes(spark: SparkSession, templates: list[dict]) -> tuple[DataFrame, DataFrame, list[str], str]:
    """(word, place, template) and (template, label, words, needed, span); the prefix words and what finds one in a text."""
    prefix = [(w, i, t["template"]) for t in templates for i, w in enumerate(t["words"][:len(t["words"]) - t["needed"] + 1])]
    starts = spark.createDataFrame(prefix, "word string, place int, template int")
    whole = spark.createDataFrame([(t["template"], t["label"], t["words"], t["needed"], t["span"]) for t in templates],
                                  "template int, label string, words array<string>, needed int, span int")
    wanted = sorted({w for w, _, _ in prefix})
    letter = r"[0-9a-z\x{80}-\x{10FFFF}]"
    # a prefix word, as a whole word and in any case
    return starts, whole, wanted, f"(?i)(?<!{letter})(?:{'|'.join(wanted)})(?!{letter})"


def block_matches(docs: DataFrame, templates: list[dict], vocabulary: list[str]) -> DataFrame:
    """(doc_id, key, template, label, containment) for blocks at or above the threshold, the best around a prefix word."""
    starts, whole, wanted, worth = prefixes(docs.sparkSession, templates)
    far = max(t["span"] for t in templates) - 1
    texts = docs.filter(F.col("text").rlike(worth)).select(
        "doc_id", text_key(F.col("text")).alias("key"), lower_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    first = F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH))
    before = lambda i: F.greatest(i - far, F.lit(0))
    stretches = texts.select("doc_id", "key", F.inline(F.transform(first, lambda i: F.struct(
        (i - before(i)).alias("lead"), F.slice("w", before(i) + 1, i - before(i) + STRETCH + far).alias("w")))))
    # prefix words of the stretch itself, not of its neighbours
    own = F.sequence(F.col("lead"), F.least(F.col("lead") + STRETCH, F.size("w")) - 1)
    spots = F.filter(own, lambda i: F.get("w", i).isin(wanted))
    around = F.transform(spots, lambda i: F.struct(F.get("w", i).alias("word"), F.least(i, F.lit(far)).alias("at"), F.slice(
        "w", F.greatest(i - far, F.lit(0)) + 1, F.least(i, F.lit(far)) + 1 + far).alias("near")))
    near = stretches.filter(F.arrays_overlap("w", F.array(*map(F.lit, wanted)))).select("doc_id", "key", F.inline(around))
    # the words of templates around a prefix word, rarest first; other words are in no template and can't match
    near = near.withColumn("common", F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("near")))
    pairs = near.join(F.broadcast(starts), "word").join(F.broadcast(whole), "template")
    possible = F.size("common") >= F.col("needed")
    reach = 1 + F.least(F.size("words") - 1 - F.col("place"),
                        F.size("common") - F.array_position("common", F.col("word"))) >= F.col("needed")
    likely = pairs.filter(possible & reach & (F.size(F.array_intersect("words", "common")) >= F.col("needed")))
    overlaps = F.transform(F.sequence(F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)), F.col("at")),
                           lambda s: F.size(F.array_intersect("words", F.slice("near", s + 1, F.col("span")))))
    return likely.withColumn("overlap", F.array_max(overlaps)).filter("overlap >= needed").select(
        "doc_id", "key", "template", "label", (F.col("overlap") / F.size("words")).alias("containment"))


def places(words: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand one after the other."""
    def starts(i: Column) -> Column:
        hit = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            hit = hit & (F.get(words, i + k) == w)
        return F.coalesce(hit, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    any_phrase = "(?i)" + "|".join(gap.join(p.split()) for p in PHRASES)
    text = F.coalesce("text", F.lit(""))
    # only a text that may hold a phrase is cut into words
    base = docs.select(
        "doc_id", text_key(F.col("text")).alias("key"), F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(text.rlike(any_phrase), lower_words(text)).alias("w"))
    hits = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), places(F.col("w"), p.split()).alias("at"))
                              for p, label in PHRASES.items())), lambda x: F.size(x["at"]) > 0)
    base = base.withColumn("hits", F.when(F.size("w") > 0, hits)).select(
        "doc_id", "key", "n_words", F.coalesce(F.flatten("hits.at"), F.array().cast("array<int>")).alias("at"),
        F.coalesce(F.col("hits.label"), F.array().cast("array<string>")).alias("base"))
    templates, vocabulary = ordered_templates(spark, docs)
    blocks = block_matches(docs, templates, vocabulary)
    found = scratch.save(blocks.groupBy("doc_id", "key").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("score")), "found")
    same = F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.key") == F.col("f.key"))
    joined = base.alias("b").join(found.alias("f"), same, "left")
    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        "b.doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
