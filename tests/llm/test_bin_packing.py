import zlib
from collections import defaultdict

import numpy as np
from brute import words

from edgetide.llm import bin_packing as b


def check(docs, total=None):
    rows, got = docs.collect(), b.shards_of(docs).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()) + 1, len(words(r.text)), zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r.bytes, r.tokens, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < b.SHARDS for s in slots)
    return got


def test_edge_rows(edge_docs, no_docs):
    check(edge_docs)
    assert b.shards_of(no_docs).count() == 0


def test_balance_and_groups_stay_together(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    load, shards = defaultdict(int), defaultdict(set)
    for r in got:
        load[r.shard] += r.bytes
        shards[r.group].add(r.shard)
    assert len(load) == b.SHARDS and max(load.values()) / min(load.values()) < 1.15


def test_hot_group_is_cut_and_small_groups_go_through_cells(spark, monkeypatch):
    monkeypatch.setattr(b, "FINE", 512)
    monkeypatch.setattr(b, "CELL", 200)
    monkeypatch.setattr(b, "SLOT_ROWS", 100)
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'the same text' else concat('text ', repeat(id, id % 7)) end as text")
    got = check(docs)
    load, rows = defaultdict(int), defaultdict(int)
    for r in got:
        load[r.shard] += r.bytes
        rows[r.shard] += 1
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) > 4
    # the law is about bytes; a group in the fewest pieces leaves rows and tokens uneven
    assert len({r.shard for r in got if r.doc_id % 3 == 0}) <= 8  # it has nearly half of all tokens
    assert max(load.values()) < 1.05 * min(load.values()) and max(rows.values()) < 2 * min(rows.values())


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups of equal texts of up to 1/16 of all bytes, beside many small ones."""
    sizes = [60, 30, 20, 20, 5, 1]  # in thousandths of the rows
    rows = [f"copy {g} with some words" for g, k in enumerate(sizes) for _ in range(10 * k)]
    rows += [f"text {i:06d} with one more" for i in range(10_000 - len(rows))]
    got = check(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    load, shards = defaultdict(int), defaultdict(set)
    for r in got:
        load[r.shard] += r.bytes
        shards[r.group].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    mean = sum(load.values()) / b.SHARDS
    assert all(abs(x / mean - 1) < 0.01 for x in load.values())


def test_place_takes_the_largest_dot_product():
    loads = np.array([[0.5, 0.1, 0.1], [0.1, 0.5, 0.1], [0.2, 0.2, 0.2]])
    capacity = np.array([[0.5, 0.3, 0.3], [0.3, 0.5, 0.3]])
    assert b.place(loads, capacity.copy()).tolist()[:2] == [0, 1]
