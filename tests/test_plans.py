"""The shape of the plans: what is pushed to the scan, what is shuffled, what is broadcast."""

import re
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as registry
from edgetide.operators import degree, edges, reach
from edgetide.operators.known import Known
from edgetide.operators.layout import lay_out
from edgetide.operators.two_hop import two_hop_index
from edgetide.scratch import Scratch
from edgetide.sources import tables
from micro import M1, edge_frame, source_frame

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(registry.__file__).parent / "edgetide"
# the subpackage has rules and tests of its own
FILES = [p for p in PACKAGE.rglob("*.py") if "llm" not in p.parts]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def orders_as_edges(spark):
    return tables.read(spark, FOLDER, "orders").selectExpr(
        "o_custkey AS src", "o_orderkey AS dst", "o_orderdate AS sent_at", "o_orderstatus AS edge_type")


def test_window_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(edges.edges_in_window(orders_as_edges(spark), "1998-01-01 00:00:00", 24).select("src", "dst"))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in text
    assert "LessThanOrEqual(o_orderdate,1998-01-02T00:00)" in text
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in schema and "o_orderstatus" not in schema


def test_degree_is_one_scan_and_one_shuffle(spark):
    text = plan(degree.degree(orders_as_edges(spark)))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text


def laid_out(spark, **options):
    temporal = edge_frame(spark, M1 * 50).selectExpr("src", "sent_at AS start_time", "sent_at AS end_time", "dst")
    layout = lay_out(temporal, "src", ["dst", "start_time"], ["start_time"], Scratch(spark), rows_per_partition=10, **options)
    layout.rows.count()
    return layout


def round_plan(spark, layout, n_frontier):
    state = reach.seed_state(source_frame(spark, [(0, 1, 0, 10)]))
    return plan(reach.candidates(layout, state, n_frontier))


def above_the_cache(text):
    """The plan without the part that fills the cache: its lines are indented below InMemoryRelation."""
    kept, depth = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and indent > depth:
            continue
        depth = indent if "InMemoryRelation" in line else None
        kept.append(line)
    return "\n".join(kept)


def test_small_frontier_is_broadcast_and_edges_stay(spark):
    layout = laid_out(spark)
    text = above_the_cache(round_plan(spark, layout, 1))
    assert "BroadcastHashJoin" in text and "BuildRight" in text
    assert not re.search(r"Exchange hashpartitioning\(src", text)
    layout.release()


def test_large_frontier_meets_edges_where_they_are(spark):
    """Neither a shuffle nor a sort on the edge side, with hot keys and without."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({}, {"hot_floor": 30}):
            layout = laid_out(spark, **options)
            assert (layout.fan is not None) == bool(options)
            text = above_the_cache(round_plan(spark, layout, 10**9))
            assert "SortMergeJoin" in text
            assert not re.search(r"Exchange hashpartitioning\(src", text)
            assert not re.search(r"Sort \[src", text)
            layout.release()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_round_shuffles_candidates_and_writes_improvements(spark):
    """Layers of what is known are neither shuffled nor sorted again, and a round writes only rows that are better."""
    scratch = Scratch(spark)
    seeds = scratch.save(reach.seed_state(source_frame(spark, [(0, n, 5, 100) for n in range(40)])), "seeds")
    known = Known(scratch, "seeds", seeds.schema, 40)
    better = seeds.filter("node_id < 4").withColumn("arrival_time", F.expr("arrival_time - interval 1 minute"))
    scratch.save(better, "one")
    known.add("one", 4)
    assert [n for _, n, _ in known.layers] == [40, 4]
    for _, n, layer in known.layers:
        assert layer.count() == n  # as after a round; before that, the plan does not know the layer's partitions yet
    found = seeds.select("source_id", "node_id", F.expr("arrival_time - interval 30 second").alias("arrival_time"), "window_end").filter("node_id < 8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        improved = known.improved(found.groupBy("source_id", "node_id").agg(F.min("arrival_time").alias("arrival_time"), F.max("window_end").alias("window_end")))
        text = above_the_cache(plan(improved))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and text.count("SortMergeJoin") == 2
    assert sorted(r["node_id"] for r in improved.collect()) == [4, 5, 6, 7]
    assert {r["node_id"]: r["arrival_time"] for r in known.rows().collect()} == {
        r["node_id"]: r["arrival_time"] for r in seeds.filter("node_id >= 4").unionByName(better).collect()}
    scratch.save(seeds.limit(30), "two")
    known.add("two", 30)
    assert [n for _, n, _ in known.layers] == [74]  # 4 <= 2 * 30, then 40 <= 2 * 34
    known.close()


def test_input_with_joins_is_computed_once(spark, monkeypatch):
    """Before the first round, lineitem is read for the copy of the window only."""
    scans = []
    save = Scratch.save

    def spy(self, df, name, partition_by=None):
        if "lineitem.parquet" in plan(df):
            scans.append(name)
        return save(self, df, name, partition_by)

    monkeypatch.setattr(Scratch, "save", spy)
    trade = tables.trade_edges(tables.read(spark, FOLDER, "orders"), tables.read(spark, FOLDER, "lineitem"))
    found = reach.reach(trade, reach.single_source(trade, 1, "1995-01-01 00:00:00", 60_000))
    assert scans == ["window"] and found.converged
    assert "lineitem.parquet" not in plan(found.arrivals)


def test_equal_edges_are_laid_out_once(spark):
    rows = edge_frame(spark, [(1, 2, 3)] * 2000 + [(1, 2, 4), (2, 1, 4)])
    one = lay_out(rows.drop("edge_id"), "src", ["dst"], ["sent_at"], Scratch(spark), collapse=True)
    assert one.rows.count() == 3 and "Exchange" in plan(one.rows)
    two = lay_out(rows, "src", ["dst"], ["sent_at"], Scratch(spark), collapse=True)
    assert sorted(r["edge_id"] for r in two.rows.collect()) == ["e00000", "e02000", "e02001"]
    for layout in (one, two):
        layout.release()


def test_index_joins_are_equi_joins(spark):
    text = plan(two_hop_index(edge_frame(spark, M1)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_plan_has_a_nested_loop_join(spark):
    for name in registry.graph_queries():
        query = registry.queries()[name]
        if not name.startswith(("reach", "earliest", "two_hop_path")):
            text = plan(query(spark, FOLDER))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_no_python_per_row_and_no_local_checkpoint():
    for path in FILES:
        text = path.read_text()
        for word in ("local" + "Checkpoint", "udf(", "mapInPandas", "applyInPandas", ".rdd", "toPandas", "crossJoin", ".cache()"):
            assert word not in text, (path, word)


def test_driver_reads_bounded_results_only():
    """Whatever comes to the driver is one aggregate row, or the keys of a frontier counted to be small."""
    found = [(p.name, line.strip()) for p in FILES for line in p.read_text().splitlines() if ".collect()" in line]
    assert found == [("layout.py", "found = [r[0] for r in keys.select(column).distinct().collect()]")]


def test_layout_hashes_no_table_of_all_edges_and_makes_no_unused_ids(spark):
    """Equal edges are found by the order that is kept anyway; the ids of trade edges are made for those who ask."""
    orders = spark.sql("SELECT 1L o_orderkey, 7L o_custkey, timestamp_ntz'2024-01-01' o_orderdate")
    lines = spark.sql("SELECT 1L l_orderkey, n l_linenumber, 3L l_suppkey, timestamp_ntz'2024-01-02' l_shipdate FROM VALUES (1), (2) t(n)")
    trade = tables.trade_edges(orders, lines)
    times = trade.select("src", "dst", "sent_at")
    assert "concat" not in times._jdf.queryExecution().optimizedPlan().toString()
    layout = lay_out(times, "src", ["dst"], ["sent_at"], Scratch(spark), collapse=True)
    assert "HashAggregate" not in layout.rows._jdf.queryExecution().toString().split("InMemoryRelation")[-1]
    assert sorted((r["src"], r["dst"]) for r in layout.rows.collect()) == [(7, 14), (14, 7)]
    found = sorted((r["edge_id"], r["src"], r["dst"], str(r["sent_at"])) for r in trade.collect())
    assert found == [("ORDER-1-1", 14, 7, "2024-01-01 00:00:00"), ("ORDER-1-2", 14, 7, "2024-01-01 00:00:00"),
                     ("SHIP-1-1", 7, 14, "2024-01-02 00:00:00"), ("SHIP-1-2", 7, 14, "2024-01-02 00:00:00")]
    layout.release()
