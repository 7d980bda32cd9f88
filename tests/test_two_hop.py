import random

import pytest
from pyspark.sql import functions as F

from edgetide.operators.degree import degree, degree_stats, in_degree, out_degree
from edgetide.operators.two_hop import current_index, merged_run, two_hop_index, two_hop_path_search, two_hop_update
from edgetide.scratch import Scratch
from micro import M1, brute_index, edge_frame, minute_of, random_graph

ROWS = {(1, 1, 2, 2, 3), (2, 0, 5, 9, 6), (2, 2, 3, 3, 4), (3, 2, 4, 4, 1), (3, 3, 4, 4, 1), (4, 4, 1, 5, 3)}


def rows(index):
    found = [(r.n1, minute_of(r.t1), r.n2, minute_of(r.t2), r.n3) for r in index.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_micro_index(spark):
    assert rows(two_hop_index(edge_frame(spark, M1))) == ROWS


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("options", [{}, {"cell_rows": 2, "block_arrivals": 2}, {"chunk_micros": 120_000_000}, {"cell_rows": 3, "chunk_micros": 1, "block_arrivals": 3}])
def test_random_index(spark, strict, options):
    rng = random.Random(3)
    edges = sum((random_graph(rng, 100 * g, nodes=5, edges=25, minutes=12) for g in range(30)), [])
    assert rows(two_hop_index(edge_frame(spark, edges), strict=strict, **options)) == brute_index(edges, strict)


def test_index_of_a_hub_and_a_hot_pair(spark):
    """One node takes part in most edges, and one pair of nodes holds a third of all."""
    rng = random.Random(9)
    edges = [(1, 2, m) for m in range(200)]
    edges += [(rng.randint(3, 30), 2, rng.randint(0, 300)) for _ in range(150)]
    edges += [(2, rng.randint(3, 30), rng.randint(0, 300)) for _ in range(150)]
    edges += [(2, 1, rng.randint(0, 300)) for _ in range(100)]
    found = rows(two_hop_index(edge_frame(spark, edges), cell_rows=20, chunk_micros=600_000_000))
    assert found == brute_index(edges)


def test_index_of_nothing(spark):
    assert two_hop_index(edge_frame(spark, M1).limit(0)).count() == 0


def search(spark, *args, **options):
    return rows(two_hop_path_search(two_hop_index(edge_frame(spark, M1)), *args, **options))


def test_path_search(spark):
    assert search(spark, 1, 4) == {(3, 3, 4, 4, 1)}
    assert search(spark, 1, 4, margin_s=60) == set()
    assert search(spark, 2, 6) == {(2, 0, 5, 9, 6)}
    assert search(spark, 5, 6) == set()
    assert search(spark, 1, 4, max_depth=0) == set()


def brute_search(index, x, y, margin_s, max_depth):
    level = {r for r in index if r[0] == x}
    for _ in range(max_depth + 1):
        hits = {r for r in level if y in (r[2], r[4])}
        if hits:
            return hits
        level = {t for t in index for n in level if t[0] == n[4] and n[3] * 60 + margin_s < t[1] * 60}
    return set()


def test_random_path_search(spark):
    rng = random.Random(21)
    edges = random_graph(rng, 0, nodes=14, edges=60, minutes=20)
    frame = edge_frame(spark, edges)
    index = two_hop_index(frame).persist()
    known = brute_index(edges)
    for x, y, margin, depth in ((0, 5, 0, 10), (3, 9, 60, 10), (2, 13, 90, 10), (7, 1, 0, 1), (4, 77, 0, 10)):
        found = rows(two_hop_path_search(index, x, y, margin, depth, rows_per_partition=5, hot_floor=2))
        assert found == brute_search(known, x, y, margin, depth)


def test_degrees(spark):
    edges = edge_frame(spark, M1)
    found = {r.node_id: (r.out_degree, r.in_degree, r.total_degree) for r in degree(edges).collect()}
    assert found == {1: (2, 1, 3), 2: (2, 1, 3), 3: (2, 2, 4), 4: (1, 2, 3), 5: (2, 1, 3), 6: (0, 2, 2)}
    stats = degree_stats(edges).first()
    assert (stats.avg_degree, stats.max_degree) == (3.0, 4)
    assert {r.node_id: r.out_degree for r in out_degree(edges).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 2}
    assert {r.node_id: r.in_degree for r in in_degree(edges).collect()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 2}


def test_the_join_reads_little_more_than_it_emits(spark):
    """2,000 edges into a node and 2,000 out of it, in time order by turns, to few targets: small cells and blocks."""
    edges = [(10 + i % 7, 2, 2 * i) for i in range(2000)] + [(2, 50 + i % 3, 2 * i + 1) for i in range(2000)]
    frame = edge_frame(spark, edges).select("src", "dst", "sent_at")
    arrivals, spans = merged_run(frame, frame, Scratch(spark), True, 100, 3_600_000_000, 16)
    index = two_hop_index(frame, cell_rows=100, block_arrivals=16).count()
    assert index == sum(1 for i in range(2000) for k in range(3) if any((i + j) % 3 == k for j in range(min(3, 2000 - i))))
    # every departure touches one or two blocks, every arrival at a node with departures stands once
    assert spans.count() < 1.5 * 2000 and arrivals.count() == 2000
    assert arrivals.count() + spans.count() < len(edges) + index


@pytest.mark.parametrize("seed", range(3))
def test_two_loads_equal_one_build(spark, seed):
    rng = random.Random(seed)
    edges = sum((random_graph(rng, 100 * g, nodes=5, edges=25, minutes=12) for g in range(10)), [])
    rng.shuffle(edges)
    cut = len(edges) // 2
    first, second = edge_frame(spark, edges[:cut]), edge_frame(spark, edges[cut - 5:])  # five edges come again
    index = Scratch(spark).save(two_hop_index(first), "index")
    changed = two_hop_update(index, first, second)
    assert rows(current_index(index.unionByName(changed))) == brute_index(edges)
    # rows of the update are new or earlier, nothing else
    before = {(r.n1, r.t1, r.n2, r.n3): r.t2 for r in index.collect()}
    for r in changed.collect():
        known = before.get((r.n1, r.t1, r.n2, r.n3))
        assert known is None or r.t2 < known


def test_an_update_looks_at_touched_middle_nodes_only(spark):
    edges = [(i, i + 1, i) for i in range(100)]
    first = edge_frame(spark, edges)
    index = Scratch(spark).save(two_hop_index(first), "index")
    changed = rows(two_hop_update(index, first, edge_frame(spark, [(50, 51, 49), (200, 50, 1)])))
    assert changed == {(200, 1, 50, 49, 51), (50, 49, 51, 51, 52)}


def test_current_index_shuffles_neighbours_together(spark):
    """Rows are dealt by middle node and hour, not by the whole key, and the earliest of equal keys stays."""
    index = two_hop_index(edge_frame(spark, random_graph(random.Random(5), 0, nodes=9, edges=60, minutes=200)))
    later = index.withColumn("t2", F.expr("t2 + interval 1 minute")).select(index.columns)
    merged = current_index(index.unionByName(later))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [n2" in plan and "chunk" in plan
    assert rows(merged) == rows(index)
