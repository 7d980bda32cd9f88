import random
import re
from pathlib import Path

import pytest

from edgetide.operators.reach import reach
from edgetide.streaming.reach_stream import ReachStream
from micro import M1, at, edge_frame, minute_of, random_graph, source_frame

SCHEMA = "edge_id string, src bigint, dst bigint, sent_at timestamp_ntz"


def found(df):
    return {r.node_id: minute_of(r.arrival_time) for r in df.collect()}


def write_batches(spark, folder, batches):
    """One file per batch; the stream reads them in this order, one per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, job):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    job.start(stream).awaitTermination()


def rows_of(edges):
    return [(f"e{i:05d}", s, d, at(m)) for i, (s, d, m) in enumerate(edges)]


@pytest.mark.parametrize("turn", [1, -1])
def test_batches_in_either_order(spark, tmp_path, turn):
    rows = rows_of(M1)[::turn]
    write_batches(spark, tmp_path / "in", [rows[:4], rows[4:6], rows[6:]])
    job = ReachStream(spark, source_frame(spark, [(0, 1, 0, 10)]), late="1 day")
    run(spark, tmp_path / "in", job)
    assert found(job.arrivals()) == {1: 0, 2: 1, 3: 2, 4: 2}


def test_replayed_batch_changes_nothing(spark):
    rows = rows_of(M1)
    job = ReachStream(spark, source_frame(spark, [(0, 1, 0, 10)]))
    batches = [spark.createDataFrame(r, SCHEMA).drop("edge_id") for r in (rows[5:], rows[:5])]
    for number in (0, 0, 1, 1, 0, 1):
        job.process(batches[number], number)
    assert found(job.arrivals(1)) == {1: 0, 2: 1, 3: 2, 4: 2}


def test_state_equals_batch_result_after_every_batch(spark):
    rng = random.Random(11)
    edges = sum((random_graph(rng, 100 * g) for g in range(10)), [])
    rng.shuffle(edges)
    sources = source_frame(spark, [(g, 100 * g, 0, 6) for g in range(10)])
    job = ReachStream(spark, sources)
    cut = [len(edges) // 3, 2 * len(edges) // 3, len(edges)]
    begin = 0
    for number, end in enumerate(cut):
        job.process(edge_frame(spark, edges[begin:end]).drop("edge_id"), number)
        begin = end
        expected = reach(edge_frame(spark, edges[:end]), sources).arrivals
        assert sorted(map(tuple, job.arrivals().collect())) == sorted(map(tuple, expected.collect()))


def test_late_and_repeated_edges_are_dropped(spark, tmp_path):
    write_batches(spark, tmp_path / "in", [
        [("a", 1, 2, at(5))],
        [("b", 2, 3, at(600))],
        [("d", 3, 4, at(610))],
        # Spark drops by the watermark one batch after it was reached: c is hours late, and the id b was seen before
        [("c", 1, 9, at(6)), ("b", 2, 8, at(600))],
    ])
    job = ReachStream(spark, source_frame(spark, [(0, 1, 0, 1000)]), late="30 minutes")
    run(spark, tmp_path / "in", job)
    assert found(job.arrivals()) == {1: 0, 2: 5, 3: 600, 4: 610}


def test_restart_goes_on(spark, tmp_path):
    sources = source_frame(spark, [(0, 1, 0, 10)])
    rows = rows_of(M1)
    write_batches(spark, tmp_path / "in", [rows[:5]])
    base = str(tmp_path / "job")
    run(spark, tmp_path / "in", ReachStream(spark, sources, base=base, late="1 day"))
    write_batches(spark, tmp_path / "in", [rows[5:]])
    again = ReachStream(spark, sources, base=base, late="1 day")
    assert len(found(again.arrivals())) > 1  # what was reached before the restart, also without new files
    run(spark, tmp_path / "in", again)
    assert found(again.arrivals()) == {1: 0, 2: 1, 3: 2, 4: 2}


def test_a_batch_writes_what_it_improves_and_now_and_then_all(spark, monkeypatch):
    monkeypatch.setattr("edgetide.streaming.reach_stream.SNAPSHOT_BATCHES", 3)
    sources = source_frame(spark, [(0, 0, 0, 1000)])
    job = ReachStream(spark, sources)
    chain = [(i, i + 1, i + 1) for i in range(8)]
    for number, edge in enumerate(chain):
        job.process(edge_frame(spark, [edge]).drop("edge_id"), number)
    written = [job.scratch.read(f"state/{n}", job.seeds.schema).count() for n in range(8)]
    assert written == [1, 1, 1, 5, 1, 1, 8, 1]
    assert found(job.arrivals()) == {i: i for i in range(9)}
    assert found(job.arrivals(4)) == {i: i for i in range(6)}
    # an edge that was missing makes all that follows earlier
    job.process(edge_frame(spark, [(0, 1, 0)]).drop("edge_id"), 8)
    assert job.scratch.read("state/8", job.seeds.schema).count() == 1 and found(job.arrivals())[1] == 0


def test_edges_of_many_batches_are_put_together_by_group(spark, monkeypatch):
    monkeypatch.setattr("edgetide.streaming.stored_edges.GROUP_BATCHES", 3)
    job = ReachStream(spark, source_frame(spark, [(0, 0, 0, 1000)]), buckets=4)
    # each edge comes before the one that leads to it, so the last batch carries on through all earlier ones
    for number in range(8):
        job.process(edge_frame(spark, [(7 - number, 8 - number, 8 - number)]).drop("edge_id"), number)
    assert found(job.arrivals()) == {i: i for i in range(9)}
    folder = Path(job.scratch.path("edges/of=4"))
    # the batches of a group go once the batch that has put them together is done
    assert sorted(p.name for p in folder.iterdir() if p.is_dir()) == ["step=b6", "step=b7", "step=c0", "step=c1"]
    # the last batch again: its edges, not those of the batches put together, are written anew
    job.process(edge_frame(spark, [(0, 1, 0)]).drop("edge_id"), 7)
    assert found(job.arrivals())[1] == 0
    with pytest.raises(ValueError, match="other buckets"):
        ReachStream(spark, job.sources, base=job.base, buckets=5).process(edge_frame(spark, [(1, 2, 3)]).drop("edge_id"), 8)


def test_rounds_read_touched_buckets_only_and_move_no_edge(spark):
    job = ReachStream(spark, source_frame(spark, [(0, 0, 0, 1000)]), buckets=64)
    job.process(edge_frame(spark, [(i, i + 1, i) for i in range(1, 40)]).drop("edge_id"), 0)
    job.process(edge_frame(spark, [(0, 38, 5)]).drop("edge_id"), 1)
    assert [len(found) for found in job.walked.touched] == [1, 1, 1] and job.walked.laid is None
    assert found(job.arrivals()) == {0: 0, 38: 5, 39: 38, 40: 39}
    walked = job.edges.since(1, 0, job.time)
    frontier = spark.range(1).selectExpr("id + 7 AS node_id")
    joined = walked.join(frontier, "node_id", 1)
    assert len(joined.collect()) == 1
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan)


def test_rounds_that_read_much_lay_the_edges_out(spark):
    rng = random.Random(5)
    sources = source_frame(spark, [(0, 0, 0, 1000)])
    job = ReachStream(spark, sources, buckets=1)
    chain = [(i, i + 1, i + 1) for i in range(7)] + [(rng.randint(0, 7), rng.randint(8, 12), 20) for _ in range(10)]
    job.process(edge_frame(spark, chain[1:]).drop("edge_id"), 0)
    job.process(edge_frame(spark, chain[:1]).drop("edge_id"), 1)
    assert job.walked.touched == [[0]] * 3 and job.walked.laid is not None
    expected = reach(edge_frame(spark, [e for e in chain if e[0] != e[1]]), sources).arrivals
    assert sorted(map(tuple, job.arrivals().collect())) == sorted(map(tuple, expected.collect()))
