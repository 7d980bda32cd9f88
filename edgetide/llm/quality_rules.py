"""Quality rules as a bitmask ledger (operator 2, DataFrame functions only).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; a policy is
a version name and a set of rules, so applying another version, or asking what a rule alone costs, reads the ledger
and never the texts.

Defined results: a null text measures as an empty one; extra columns are carried along by ``ledger``; repeated rows
are judged one by one; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, window_hashes, words

SYMBOL = r"[#*$%&|<>]"
REPEAT_WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words"]


@dataclass(frozen=True)
class Rule:
    """``fails``: a condition on the measurements ``m``. Bit positions never change once they are given out."""
    name: str
    bit: int
    fails: Callable[[Mapping[str, Column] | Column], Column]


RULES = [
    Rule("few_words", 0, lambda m: m["n_words"] < 10),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", 3, lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("short_words", 4, lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", 5, lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("few_distinct_words", 6, lambda m: (m["n_words"] >= 50) & (100 * m["n_unique_words"] < 10 * m["n_words"])),
]
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "duplicate_lines"],
    "v2": [r.name for r in RULES],
}
POLICY = "v2"


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more.

    Sorting (hash, start) brings equal windows together; the covered words are then the gaps between the starts of
    repeated windows, at most a window each. Texts without a repeated window never get that far.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # as the one element of an array, the sorted pairs are computed once however often they are looked at
    starts = F.sort_array(F.flatten(F.transform(F.array(pairs), lambda s: F.transform(
        F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"])),
        lambda x: x["i"]))))
    covered = F.aggregate(starts, F.struct(F.lit(-REPEAT_WINDOW).alias("at"), F.lit(0).alias("n")), lambda acc, at: F.struct(
        at.alias("at"), (acc["n"] + F.least(F.lit(REPEAT_WINDOW), at - acc["at"])).alias("n")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0).cast("long")


def measured(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name`` of the measurements, in steps, so that no text is split twice."""
    split, hashed, windows = fresh(docs, "_split"), fresh(docs, "_hashed"), fresh(docs, "_windows")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, line = F.col(f"{split}.w"), F.col(f"{split}.line")
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)),
        "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)),
        "n_lines": F.size(line),
        "n_unique_words": F.size(F.array_distinct(hashed)),
        "n_repeat_words": _repeat_words(F.col(windows)),
    }
    return (
        docs.withColumn(split, F.struct(words(F.col("text")).alias("w"), lines.alias("line")))
        .withColumn(hashed, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(windows, window_hashes(F.col(hashed), REPEAT_WINDOW))
        .withColumn(name, F.struct(*(values[c].cast("long").alias(c) for c in MEASURES)))
        .drop(split, hashed, windows))


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The columns of ``docs`` but its text, the measurements, and ``failed``: one bit per failed rule.

    A column of ``docs`` that has the name of a measurement gives way to it.
    """
    kept = [c for c in docs.columns if c.lower() not in ("text", "failed", *MEASURES)]
    m = fresh(docs, "_m")
    return measured(docs, m).select(*(F.col(f"`{c}`") for c in kept), f"{m}.*").withColumn(
        "failed", failure_bits({c: F.col(c) for c in MEASURES}, rules))


def failure_bits(m: Mapping[str, Column] | Column, rules: list[Rule]) -> Column:
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[policy])


def rejected(policy: str) -> Column:
    """The bits of a ledger row that count under a policy; 0: kept."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))


def ablations(entries: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents it fails, and documents that only it rejects.

    Ledger rows collapse to their bit patterns first, so at most 2^rules rows go on.
    """
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(r.name).alias("rule"),
                               F.lit(1 << r.bit).cast("long").alias("bit")) for p in POLICIES for r in RULES if r.name in POLICIES[p]))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return patterns.select("failed", "n", F.inline(cases)).groupBy("policy", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("fails_alone"))


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns as they were."""
    m, place = fresh(docs, "_m"), fresh(docs, "_place")
    counted = [r for r in RULES if r.name in POLICIES[policy]]
    # A filter on computed columns would be pushed below the steps that compute them, each step written out inside the
    # next; it stays above a projection that numbers the rows, since that is not deterministic.
    placed = measured(docs, m).withColumn(place, F.monotonically_increasing_id())
    return placed.filter((failure_bits(F.col(m), counted) == 0) & (F.col(place) >= 0)).drop(m, place)
