"""Benchmark decontamination by template canonicalisation (operator 4, DataFrame functions only).

Texts become templates: numbers, names (a capitalised word inside a sentence; words in capitals throughout are words) and units (after a number) are replaced
by typed placeholders, all else is lower-cased words. What is a name depends on its case, so there is a second, literal
template: all words lower-cased, with their values. Windows of ``WINDOW`` words of the benchmark are hashed in both
forms and joined with those of every document, in both forms, at every position; one of the two is enough.

Hits of an item at nearly the same shift (within ``BAND`` words) are taken together, so that words inserted, left out or
replaced only cost the windows that hold them. A document leaks an item if such hits cover ``COVERAGE`` of the item's
words: a whole item with a few words changed does, a quote of half of it does not. Slots must be consistent: equal
values of the item stand for equal values of the document and the other way round, over all alignments together or,
where these contradict each other, within a single one that covers enough. All slots between an alignment's first and
last word count, whether a window holds them or not. So a question asked again with other numbers
or names is found, and one that only looks alike is not.

A typed window needs ``LITERALS`` words outside placeholders; a literal one holds its values and needs none. Items of
fewer than ``WINDOW`` words say too little to be looked for inside texts: they are leaked by documents that consist of
the same words and nothing else.

Defined results: null and empty texts leak nothing; texts of any length are read whole; repeated rows and texts all leak; equal benchmark items are all
reported; items without words are leaked by none; empty tables give empty results; extra columns are carried along by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch, broadcast_below, content_key, fresh, window_hashes

WINDOW, LITERALS = 4, 3
BAND = 16
COVERAGE = 0.6
BROADCAST_ROWS = 500_000  # at most so many rows of two or three numbers are broadcast; more are joined by shuffle
NAME_MARK, UNIT_MARK = "\u0002", "\u0003"
# Units that follow a number.
UNITS = ("mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles mg g kg t lb lbs oz pound pounds ml l "
         "liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours "
         "day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent "
         "kmh mph km/h m/s c f k w kw kwh v a hz khz mhz ghz kb mb gb tb").split()


def tokens(text: Column) -> Column:
    """Words and numbers in lower case; names and units carry their mark.

    Repeated groups are possessive: Java matches those in a loop, others by recursion, which long lists overflow.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Lu})(?=\p{Ll})(?<=[\p{L}\p{N},;]\s{1,4}.)", f"{NAME_MARK}$1")
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    marked = F.regexp_replace(F.lower(marked), rf"([0-9] ?)(?=(?:{units})(?![\p{{L}}\p{{N}}]))", f"$1{UNIT_MARK}")
    return F.regexp_extract_all(
        marked, F.lit(rf"[{NAME_MARK}{UNIT_MARK}]?[\p{{L}}\p{{M}}]+|[0-9]++(?:[.,:/][0-9]++)*+"), F.lit(0))


def is_slot(token: Column) -> Column:
    """Marks and digits sort before ':', letters after it."""
    return token < ":"


def token_hashes(words: Column) -> Column:
    """A hash for each literal word, 1 for a number, 2 for a unit, 3 for a name."""
    return F.transform(words, lambda x: F.when(x >= ":", F.xxhash64(x)).when(x >= "0", F.lit(1).cast("long"))
                       .when(x.startswith(UNIT_MARK), F.lit(2).cast("long")).otherwise(F.lit(3).cast("long")))


def literal_hashes(words: Column) -> Column:
    """A hash for each word or number as it is, whether or not it is a name or a unit."""
    return F.transform(words, lambda x: F.xxhash64(F.translate(x, NAME_MARK + UNIT_MARK, "")))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, slots, words, hashes, literals) of each item that has words; n is their number."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return items.select("item_id", F.size("words").alias("n"), F.exists("words", is_slot).alias("slots"), "words",
                        token_hashes(F.col("words")).alias("hashes"), literal_hashes(F.col("words")).alias("literals"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n, slots, at, hash): the windows of each item in literal form and, where that is another and
    holds words enough, in typed form."""
    at = F.posexplode(F.arrays_zip(window_hashes(F.col("literals"), WINDOW).alias("one"), window_hashes(F.col("hashes"), WINDOW).alias("two")))
    each = items.filter(F.col("n") >= WINDOW).select("item_id", "n", "slots", "words", at.alias("at", "w"))
    told = F.size(F.filter(F.slice("words", F.col("at") + 1, WINDOW), lambda x: ~is_slot(x))) >= LITERALS
    forms = F.when(told & (F.col("w.one") != F.col("w.two")), F.array("w.one", "w.two")).otherwise(F.array("w.one"))
    return each.select("item_id", "n", "slots", "at", F.explode(forms).alias("hash"))


def covered(at: Column) -> Column:
    """The item's words that windows at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(i, i + WINDOW - 1)))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, coverage, slots, changed) for every document and item that it leaks.

    ``slots``: placeholders that were checked; ``changed``: those whose value differs from the item's.
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.save(item_words(benchmark), "items")
    lookup = broadcast_below(scratch.save(item_windows(items), "lookup"), BROADCAST_ROWS)

    hashed = docs.select("doc_id", content_key(F.col("text")).alias("key"), tokens(F.col("text")).alias("words")).select(
        "doc_id", "key", token_hashes(F.col("words")).alias("hashes"), literal_hashes(F.col("words")).alias("literals"))
    both = F.arrays_zip(window_hashes(F.col("literals"), WINDOW).alias("one"), window_hashes(F.col("hashes"), WINDOW).alias("two"))
    forms = hashed.select("doc_id", "key", F.posexplode(both).alias("pos", "w")).select(
        "doc_id", "key", "pos", F.explode(F.array_distinct(F.array("w.one", "w.two"))).alias("hash"))
    hits = forms.join(lookup, "hash").select("doc_id", "key", "item_id", "at", "n", "slots", (F.col("pos") - F.col("at")).alias("shift"))
    # repeated rows hit the same windows again, hence sets; a set has at most the windows of an item
    aligned = hits.groupBy("doc_id", "key", "item_id", "n", "slots", "shift").agg(F.collect_set("at").alias("at"))
    # two bands hold each shift, so that shifts less than BAND apart share one
    band = F.floor(F.col("shift") / BAND)
    banded = aligned.withColumn("band", F.explode(F.array(band, band - 1))).groupBy("doc_id", "key", "item_id", "n", "slots", "band").agg(
        F.collect_list(F.struct("shift", "at")).alias("found"))
    banded = banded.withColumn("coverage", covered(F.flatten("found.at")) / F.col("n")).filter(F.col("coverage") >= COVERAGE)
    likely, seen = scratch.save_counted(banded, "likely", F.count_if("slots").alias("slotted"))
    none = F.lit(0)
    plain = likely.filter("not slots").groupBy("doc_id", "key", "item_id").agg(F.max("coverage").alias("coverage")).select(
        "*", none.alias("slots"), none.alias("changed"))
    whole = short_leaks(docs, items).select(*plain.columns)
    if not seen["slotted"]:
        return plain.unionByName(whole)
    checked = check_slots(likely.filter("slots").drop("doc_id").dropDuplicates(["key", "item_id", "band"]), docs, items)
    found = likely.filter("slots").select("doc_id", "key", "item_id").distinct().join(checked, ["key", "item_id"])
    return plain.unionByName(whole).unionByName(found.select(plain.columns))


def short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that consist of the words of an item too short for a window."""
    short = items.filter(F.col("n") < WINDOW).select("item_id", F.col("literals").alias("own"))
    # at most WINDOW - 1 words of five bytes at least and what stands between them; longer texts may be as short in words
    few = docs.select("doc_id", content_key(F.col("text")).alias("key"), literal_hashes(tokens(
        F.when(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]++")) <= 8 * WINDOW, F.col("text")))).alias("own"))
    few = few.filter((F.size("own") < WINDOW) & (F.size("own") > 0))
    return few.join(short, "own").select("doc_id", "key", "item_id", F.lit(1.0).alias("coverage"), F.lit(0).alias("slots"),
                                         F.lit(0).alias("changed")).distinct()


def check_slots(likely: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, coverage, slots, changed) over the alignments whose placeholders are consistent, as literal ones are."""
    asked = items.select("item_id", F.col("words").alias("asked"))
    texts = docs.select(content_key(F.col("text")).alias("key"), "text").join(
        likely.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", tokens(F.col("text")).alias("words"))
    aligned = likely.select("key", "item_id", "n", "band", F.inline("found")).join(texts, "key").join(asked, "item_id")
    # all slots from an alignment's first word to its last, also between windows, where the document has one of the kind
    places = F.sequence(F.array_min("at"), F.array_max("at") + WINDOW - 1)

    def kind(word: Column) -> Column:
        return F.when(word >= ":", "word").when(word >= "0", "number").when(word.startswith(UNIT_MARK), "unit").otherwise("name")

    slots = F.filter(places, lambda p: is_slot(F.get("asked", p)) & (kind(F.get("asked", p)) == kind(F.get("words", (p + F.col("shift")).cast("int")))))
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(
        F.get("asked", p).alias("asked"), F.get("words", (p + F.col("shift")).cast("int")).alias("given"))))
    aligned = aligned.select("key", "item_id", "n", "band", "at", pairs.alias("pairs")).filter(consistent(F.col("pairs")))
    best = F.max(covered(F.col("at"))).alias("single")
    joint = aligned.groupBy("key", "item_id", "n", "band").agg(
        F.flatten(F.collect_list("at")).alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), best,
        F.max(F.size("pairs")).alias("most"))
    agreed = consistent(F.col("pairs"))
    words = F.when(agreed, covered(F.col("at"))).otherwise(F.col("single"))
    changed = F.size(F.filter("pairs", lambda x: x["asked"] != x["given"]))
    return joint.select("key", "item_id", (words / F.col("n")).alias("coverage"), F.when(agreed, F.size("pairs")).otherwise(F.col("most")).alias("slots"),
                        changed.alias("changed")).filter(F.col("coverage") >= COVERAGE).groupBy("key", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max_by("slots", "coverage").alias("slots"), F.min_by("changed", F.struct(-F.col("coverage"), "changed")).alias("changed"))


def consistent(pairs: Column) -> Column:
    """Whether no value of the item stands for two values of the document, and none of the document for two of the item."""
    distinct = F.size(pairs)
    return (F.size(F.array_distinct(F.transform(pairs, lambda x: x["asked"]))) == distinct) & (
        F.size(F.array_distinct(F.transform(pairs, lambda x: x["given"]))) == distinct)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns as they were."""
    scratch = Scratch(docs.sparkSession)
    key = fresh(docs, "_key")
    bad = scratch.save(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias(key)).distinct(), "bad")
    return docs.withColumn(key, content_key(F.col("text"))).join(broadcast_below(bad, BROADCAST_ROWS), key, "left_anti").drop(key)
