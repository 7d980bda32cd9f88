from brute import leaked
from edgetide.llm import template_leaks as t

ITEM = "A train leaves London at 9 and travels 60 km each hour, when does it reach the town of Oxford that is 120 km away"
PLAIN = "the quick brown fox jumps over the lazy dog while seven small birds watch from a very old tree"


def tables(spark, texts, items=((1, ITEM), (2, PLAIN))):
    return (spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
            spark.createDataFrame(list(items), "item_id long, text string"))


def found(spark, texts, **kw):
    return {(r.doc_id, r.item_id): r for r in t.leaks(*tables(spark, texts, **kw)).collect()}


def test_copies_and_reparameterised_items_are_found(spark):
    other = ITEM.replace("London", "Paris").replace("9", "10").replace("60", "75").replace("120", "150").replace("Oxford", "Lyon")
    got = found(spark, ["intro words here. " + ITEM + " and more", "before, " + other, "say " + PLAIN.upper(), "clean text " * 30, None, ""])
    assert set(got) == {(0, 1), (1, 1), (2, 2)}
    assert got[0, 1].changed == 0 and got[1, 1].changed >= 4


def test_inconsistent_slots_are_no_leak(spark):
    # the item's two equal numbers stand for different ones: another question
    item = "add 5 to the number that you have and then take 5 away from it to see what is left over"
    items = ((7, item),)
    same, mixed = item.replace("5", "8"), item.replace("5", "8", 1).replace(" 5 ", " 9 ")
    assert set(found(spark, [same, mixed], items=items)) == {(0, 7)}


def test_most_of_an_item_is_needed_and_changed_words_do_not_hide_it(spark):
    w = PLAIN.split()
    few, split, other = " ".join(w[:9]), " ".join(w[:9] + ["indeed"] + w[9:]), " ".join(w[:6] + ["indeed"] + w[7:13] + ["indeed"] + w[14:])
    got = found(spark, ["so " + few + " and that is all", "so " + split, "so " + other, "so " + " ".join(w[:4] + w[6:])])
    assert set(got) == {(1, 2), (2, 2), (3, 2)} and all(r.coverage >= t.COVERAGE for r in got.values())
    long = PLAIN + " and " + " ".join(f"word{i}x" for i in range(30))
    v = long.split()
    got = found(spark, [" ".join(v[:20] + ["indeed"] + v[20:])], items=((3, long),))
    assert set(got) == {(0, 3)} and got[0, 3].coverage < 1


def test_short_items_repeats_and_ties(spark):
    items = ((1, "what is love baby don't"), (2, "what is love baby don't"), (3, "1 2 3 4 5"), (4, "no"), (5, None))
    got = found(spark, ["oh what is love baby don't hurt", "oh what is love baby don't hurt", "1 2 3 4 5"], items=items)
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 3)}


def test_items_too_short_for_a_window_are_whole_documents(spark):
    items = ((1, "No way!"), (2, "17 * 23"), (3, "..."), (4, "What is 17 * 23?"))
    got = found(spark, ["no WAY", "no way at all", "17*23", "17 23 5", "", "... -", "so what is 17 * 23 again", "what is 18 * 23"], items=items)
    assert set(got) == {(0, 1), (2, 2), (6, 4)}


def test_clean_keeps_rows_and_columns(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(40)))], "item_id long, text string")
    kept = t.clean(edge_docs, bench)
    assert kept.schema == edge_docs.schema
    # of the edited copy, 25 of the item's 33 windows are left
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9]
    assert t.clean(no_docs, bench).count() == 0
    assert t.clean(edge_docs, bench.limit(0)).count() == edge_docs.count()


def test_whole_table_equals_brute_force(spark, sf):
    """Items of the tables hold no slots, so a leak is ``COVERAGE`` of an item's words under 4-word windows of the
    document whose shifts share a band."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = leaked([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert want and {(r.doc_id, r.item_id) for r in t.leaks(docs, bench).collect()} == want


def test_recall_of_changed_items_is_high(spark):
    """Each item of a table with one or two words replaced, or one inserted, within other text."""
    import random
    dice, texts, of = random.Random(1), [], []
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    for r in bench.collect():
        w = r.text.split()
        one, two, more = list(w), list(w), list(w)
        one[dice.randrange(len(w))] = "zzyx"
        for i in dice.sample(range(len(w)), 2):
            two[i] = "zzyx"
        more.insert(dice.randrange(len(w)), "zzyx")
        for x in (one, two, more):
            texts.append("before it " * 20 + " ".join(x) + " after it" * 20)
            of.append(r.item_id)
    got = {(r.doc_id, r.item_id) for r in t.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert len({d for d, i in got if of[d] == i}) >= 0.97 * len(texts) and not [1 for d, i in got if of[d] != i]


def test_copies_in_another_case_or_with_line_breaks_are_found(spark):
    broken = ITEM.replace(" London", "\nLondon").replace(" Oxford", "\r\n  Oxford")
    german = "Der Zug verlässt den Bahnhof der Stadt Bremen um 9 Uhr und fährt über Land bis zum Hafen von Emden an der Küste"
    names = "Anna Berta Clara Dora Emma Frieda Greta Hanna Ida 7"
    texts = [ITEM.lower(), ITEM.upper(), broken, german.lower(), german.upper(), german, "so " + names.lower(), names.replace("7", "8").upper(), "anna berta"]
    got = found(spark, texts, items=((1, ITEM), (2, german), (3, names)))
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3), (7, 3)}
    assert all(r.coverage == 1 and r.changed == 0 for k, r in got.items() if k != (7, 3))


def test_long_lists_of_numbers_and_words_do_not_crash(spark):
    texts = ["7" + ",7" * 1_000_000, "1:2/3." * 300_000, "x" * 1_000_000, "A" + "b" * 1_000_000, "9 km" * 200_000, "so " + ITEM + " 3" + ",4" * 500_000]
    assert set(found(spark, texts)) == {(5, 1)}
