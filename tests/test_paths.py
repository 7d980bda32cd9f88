"""Paths walked back by doubling."""

import warnings

import pytest

from edgetide.operators.paths import earliest_path, predecessors
from edgetide.operators.reach import RoundLimit, reach_one
from edgetide.scratch import Scratch
from micro import at, edge_frame, source_frame


def test_a_chain_of_a_thousand_edges_takes_few_jobs(spark, monkeypatch):
    n = 1000
    tree = spark.createDataFrame([(s, i, i - 1 if i else None, f"e{i}", at(i)) for s in (0, 1) for i in range(n + 1)],
                                 "source_id long, node_id long, via_src long, via_edge string, arrival_time timestamp_ntz")
    jobs = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, partition_by=None: jobs.append(name) or save(self, df, name, partition_by))

    class Found:
        arrivals, converged, rounds = tree, True, []

    monkeypatch.setattr("edgetide.operators.paths.reach", lambda *a, **k: Found)
    path = earliest_path(tree, tree, targets=spark.createDataFrame([(n,), (3,), (0,)], "node_id long"))
    rows = path.select("source_id", "target", "step", "node_id", "edge_id").collect()
    assert len(jobs) <= 12
    for source in (0, 1):
        for target in (n, 3, 0):
            mine = sorted(r[2:] for r in rows if r["source_id"] == source and r["target"] == target)
            assert mine == [(i, i, f"e{i}") for i in range(target + 1)]


def test_no_edges_and_no_predecessors(spark):
    edges, sources = edge_frame(spark, [(1, 2, 3)]), source_frame(spark, [(0, 9, 0, 10)])
    rows = earliest_path(edges, sources).collect()
    assert [(r["target"], r["step"], r["node_id"], r["edge_id"]) for r in rows] == [(9, 0, 9, None)]
    empty = spark.createDataFrame([], "source_id long, node_id long, via_src long")
    assert predecessors(empty, Scratch(spark)) == []


def test_a_limit_on_rounds_is_told(spark):
    edges = edge_frame(spark, [(i, i + 1, i) for i in range(6)])
    sources = source_frame(spark, [(0, 0, 0, 10)])
    with pytest.warns(RoundLimit):
        assert reach_one(edges, 0, at(0), 1, max_rounds=2).count() == 3
    with pytest.warns(RoundLimit):
        assert earliest_path(edges, sources, max_rounds=2).filter("target = 2").count() == 3
    with warnings.catch_warnings():
        warnings.simplefilter("error", RoundLimit)
        assert reach_one(edges, 0, at(0), 1, max_rounds=9).count() == 7
