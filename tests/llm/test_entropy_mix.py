from collections import defaultdict

import pytest
from brute import targets, words

from edgetide.llm import entropy_mix as e


def check(docs, near):
    rows = docs.collect()
    got = e.mix(docs).select("doc_id", "source", "_mix.*").collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size and 0 <= r.rate <= 2
        taken[r.source] += r.taken
    largest = max((r.size for r in got), default=0)
    assert all(abs(taken[s] - want[s]) <= max(near, largest / 2) for s in sizes)
    return got


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs, 40)
    mixed = e.mixed(edge_docs)
    assert mixed.schema == edge_docs.schema
    assert mixed.count() == sum(r["_mix"]["copies"] for r in e.mix(edge_docs).collect())
    assert e.mix(no_docs).count() == 0 and e.mixed(no_docs).count() == 0


def test_whole_table_near_targets_and_rerun_agrees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(docs, 100)
    again = e.mix(docs.repartition(3)).select("doc_id", "_mix.*").collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_rates_are_the_tilt_that_meets_the_constraint(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', id % 6) as source")
    got = e.mix(docs).select("source", "_mix.*").collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target, rel=1e-6)


def test_hot_cell_is_dealt_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(e, "BUCKET_ROWS", 50)
    docs = spark.range(2000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'one two three' else repeat('w ', cast(id % 90 as int)) end as text",
                                        "concat('s', id % 2) as source")
    check(docs, 3)


def test_too_few_steps_are_an_error(spark, sf, monkeypatch):
    monkeypatch.setattr(e, "STEPS", 1)
    with pytest.raises(RuntimeError, match="steps"):
        e.mix(spark.read.parquet(f"{sf}/documents.parquet"))
