from brute import quality

from edgetide.llm import quality_rules as q


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_measures_equal_brute_force(spark, edge_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(20, "a b c d e a b c d e f"), (21, "x x x x x x"), (22, "a\na\nb\n\n\na"), (23, "<p> # | é😀 $")], "doc_id long, text string"))
    for table in (docs, more):
        got = sorted((r["doc_id"] or -1, *(r[c] for c in q.MEASURES)) for r in collect(q.ledger(table)))
        want = sorted((r["doc_id"] or -1, *(quality(r["text"])[c] for c in q.MEASURES)) for r in collect(table))
        assert got == want


def test_ledger_bits_policies_and_kept_rows(edge_docs):
    entries = {(r["doc_id"], r["n_words_"] if "n_words_" in r else r["word_chars"]): r for r in collect(q.ledger(edge_docs))}
    assert all(r["failed"] & 1 == (r["n_words"] < 10) for r in entries.values())
    kept = q.keep(edge_docs)
    assert kept.columns == edge_docs.columns and kept.schema == edge_docs.schema
    assert sorted((r["doc_id"] or -1) for r in collect(kept)) == [-1, 1, 1, 2, 6, 8]


def test_ablations_equal_rereading(edge_docs, spark, sf):
    entries = q.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r["failed"] for r in collect(entries)]
    for r in collect(q.ablations(entries)):
        bit, mask = next(1 << x.bit for x in q.RULES if x.name == r["rule"]), q.mask(r["policy"])
        assert r["fails"] == sum(bool(b & bit) for b in bits)
        assert r["fails_alone"] == sum(b & mask == bit for b in bits)


def test_empty_table(no_docs):
    assert q.ledger(no_docs).count() == 0 and q.keep(no_docs).count() == 0 and q.ablations(q.ledger(no_docs)).count() == 0
