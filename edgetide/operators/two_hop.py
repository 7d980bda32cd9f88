"""Two-hop temporal index and the target search over it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetide.operators.layout import BROADCAST_ROWS, lay_out
from edgetide.schema import micros
from edgetide.scratch import Scratch

# Targets whose departures meet the same arrivals in one group of the join; those of a hub with more are spread.
CELL_ROWS = 20_000
# Arrivals of one middle node that are joined together.
BLOCK_ARRIVALS = 64
HOUR = 3_600_000_000
# Parts of the targets by which an hour of a middle node is spread.
TARGET_PARTS = 16
INDEX = ["n1", "t1", "n2", "t2", "n3"]
INDEX_KEY = ["n1", "t1", "n2", "n3"]


def two_hop_index(edges: DataFrame, strict: bool = True, cell_rows: int = CELL_ROWS,
                  chunk_micros: int = HOUR, block_arrivals: int = BLOCK_ARRIVALS) -> DataFrame:
    """(n1, t1, n2, t2, n3): for each edge n1 -> n2 at t1 and each n3, the earliest onward edge n2 -> n3 after t1.

    Joining all pairs of edges that meet in n2 and keeping the minimum would emit in-degree times out-degree rows.
    Here arrivals and departures of a middle node are merged into one run in time order, and arrivals are numbered.
    A departure to n3 is the earliest one for just those arrivals that lie between the departure to n3 before it and
    itself: a range of numbers. Departures without arrivals in their range are dropped, all others stay open over the
    blocks of ``block_arrivals`` arrivals that their range touches. So a departure is copied once per block, not once
    per arrival, and the join compares little more rows than it emits.
    """
    distinct = edges.select("src", "dst", "sent_at")
    return join_hops(distinct, distinct, Scratch(edges.sparkSession), strict, cell_rows, chunk_micros, block_arrivals)


def join_hops(first: DataFrame, second: DataFrame, scratch: Scratch, strict: bool = True, cell_rows: int = CELL_ROWS,
              chunk_micros: int = HOUR, block_arrivals: int = BLOCK_ARRIVALS) -> DataFrame:
    """Index rows of the edges ``first`` (src, dst, sent_at) with the earliest onward edges among ``second``."""
    arrivals, spans = merged_run(first, second, scratch, strict, cell_rows, chunk_micros, block_arrivals)
    between = (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high"))
    return arrivals.join(spans, ["n2", "block", "cell"]).filter(between).select(*INDEX)


def merged_run(first: DataFrame, second: DataFrame, scratch: Scratch, strict: bool, cell_rows: int, chunk_micros: int,
               block_arrivals: int) -> tuple[DataFrame, DataFrame]:
    """Arrivals (n2, block, cell, place, n1, t1) and departures (n2, block, cell, low, high, n3, t2), once for each
    block between the first and the last arrival they are the earliest for: those with low <= place < high."""
    name = uuid.uuid4().hex
    chunk = F.floor(micros(F.col("at")) / chunk_micros).alias("chunk")
    arriving = first.selectExpr("dst AS n2", "src AS other", "sent_at AS at", "1 AS kind")
    # at equal times a departure comes before an arrival that may not use it, else behind
    leaving = second.selectExpr("src AS n2", "dst AS other", "sent_at AS at", f"{0 if strict else 2} AS kind")
    both = arriving.unionByName(leaving).filter("n2 IS NOT NULL AND other IS NOT NULL AND at IS NOT NULL")
    run = scratch.save(both.dropDuplicates().select("*", chunk), f"run-{name}")
    # Numbers are found in two steps, within time chunks of a node and from chunk to chunk, so that a node or a pair
    # with a large part of all edges is not one window group.
    per_chunk = run.groupBy("n2", "chunk").agg(F.count_if(F.col("kind") == 1).alias("n_in"))
    # about as many departures as a node has targets are open at a time
    targets = run.filter("kind <> 1").groupBy("n2").agg(F.approx_count_distinct("other").alias("targets"))
    node = Window.partitionBy("n2")
    before = F.coalesce(F.sum("n_in").over(node.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = F.greatest(F.lit(1), F.ceil(F.col("targets") / cell_rows)).cast("int")
    # nodes without departures are in no index row
    per_chunk = per_chunk.select("n2", "chunk", before.alias("before")).join(targets, "n2").select(
        "n2", "chunk", "before", cells.alias("cells"))
    so_far = F.count_if(F.col("kind") == 1).over(
        Window.partitionBy("n2", "chunk").orderBy("at", "kind", "other").rowsBetween(Window.unboundedPreceding, 0))
    numbered = scratch.save(run.withColumn("so_far", so_far).join(per_chunk, ["n2", "chunk"]).select(
        "n2", "chunk", "other", "at", "kind", (F.col("before") + F.col("so_far")).alias("number"), "cells"), f"numbered-{name}")

    block = F.floor((F.col("number") - 1) / block_arrivals)
    arrivals = numbered.filter("kind = 1").select(
        "n2", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"),
        (F.col("number") - 1).alias("place"), F.col("other").alias("n1"), F.col("at").alias("t1"))
    departures = numbered.filter("kind <> 1 AND number > 0")
    pair = Window.partitionBy("n2", "other").orderBy("chunk")
    last = departures.groupBy("n2", "other", "chunk").agg(F.max("number").alias("last")).select(
        "n2", "other", "chunk", F.lag("last").over(pair).alias("before_chunk"))
    in_chunk = Window.partitionBy("n2", "other", "chunk").orderBy("at")
    low = F.coalesce(F.lag("number").over(in_chunk), "before_chunk", F.lit(0))
    spans = departures.join(last, ["n2", "other", "chunk"]).withColumn("low", low).filter("low < number").select(
        "n2", F.explode(F.sequence(F.floor(F.col("low") / block_arrivals), block)).alias("block"),
        F.pmod(F.xxhash64("other"), F.col("cells")).cast("int").alias("cell"),
        "low", F.col("number").alias("high"), F.col("other").alias("n3"), F.col("at").alias("t2"))
    return arrivals, spans


def two_hop_update(index: DataFrame, edges: DataFrame, new_edges: DataFrame, **options) -> DataFrame:
    """The index rows (n1, t1, n2, t2, n3) that ``new_edges`` add to the index of ``edges`` or make earlier.

    Only middle nodes at which a new edge arrives or leaves are looked at. A row replaces the one with the same
    (n1, t1, n2, n3); ``current_index`` puts both together.
    """
    scratch = Scratch(edges.sparkSession)
    columns = ["src", "dst", "sent_at"]
    known, new = edges.select(columns), new_edges.select(columns).distinct()
    new = scratch.save(new.join(known, columns, "left_anti"), "new")
    entered = _touched(new, "dst", scratch)
    left = _touched(new, "src", scratch)

    def at(df: DataFrame, column: str, nodes: DataFrame) -> DataFrame:
        return df.join(nodes.withColumnRenamed("node_id", column), column, "left_semi")

    added = join_hops(new, at(known, "src", entered).unionByName(new), scratch, **options)
    beating = join_hops(at(known, "dst", left), new, scratch, **options)
    present = at(index, "n2", left).groupBy(*INDEX_KEY).agg(F.min("t2").alias("present"))
    better = beating.join(present, INDEX_KEY, "left").filter("present IS NULL OR t2 < present").select(*INDEX)
    return added.unionByName(better)


def _touched(new: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    nodes, seen = scratch.save_counted(
        new.select(F.col(column).alias("node_id")).distinct(), f"touched-{column}", F.count(F.lit(1)).alias("n"))
    return F.broadcast(nodes) if seen["n"] <= BROADCAST_ROWS else nodes


def current_index(rows: DataFrame) -> DataFrame:
    """The index from its rows and those of later updates: of each (n1, t1, n2, n3) the earliest.

    Rows are shuffled by middle node, hour and a part of the targets, in which neighbours share most of their values, as
    they come out of the join: so they take much less room than dealt out by the whole key. A node's hour is in
    ``TARGET_PARTS`` pieces, so that a busy one is not one task.
    """
    place = {"chunk": F.floor(micros(F.col("t1")) / HOUR), "part": F.pmod(F.xxhash64("n3"), F.lit(TARGET_PARTS))}
    placed = rows.select(*INDEX).withColumns(place).repartition("n2", *place)
    return placed.groupBy(*place, *INDEX_KEY).agg(F.min("t2").alias("t2")).select(*INDEX)


def two_hop_path_search(index: DataFrame, start: int, target: int, margin_s: int = 0, max_depth: int = 10,
                        **layout_options) -> DataFrame:
    """Index rows that touch ``target`` on the first level of the search from ``start`` that has any.

    Level 0 are the index rows leaving ``start``; each further level holds the rows that leave a node reached by
    the level before, more than ``margin_s`` seconds after the arrival there; at most ``max_depth`` further levels.
    A row belongs to a level when any arrival at its first node lets it follow, so a level is remembered as the
    earliest arrival per node: one row per node instead of one per path.
    """
    empty = index.limit(0)
    scratch = Scratch(index.sparkSession)
    hits = (F.col("n2") == target) | (F.col("n3") == target)
    time = index.schema["t2"].dataType.simpleString()
    level = index.filter(F.col("n1") == start)
    layout = None
    n_nodes = None
    try:
        for depth in range(max_depth + 1):
            if depth:
                layout = layout or lay_out(index, "n1", ["n3", "t1"], ["t1"], scratch, **layout_options)
                level = layout.join(reached, "node_id", n_nodes, "e.t1 > f.ready_at").selectExpr(
                    "e.n1", "e.t1", "e.n2", "e.t2", "e.n3")
            summary = level.groupBy(F.col("n3").alias("node_id")).agg(
                F.expr(f"CAST(min(t2) + make_dt_interval(0, 0, 0, {margin_s}) AS {time})").alias("ready_at"),
                F.max(hits).alias("hit"))
            reached, seen = scratch.save_counted(
                summary, f"level-{depth}", F.count(F.lit(1)).alias("nodes"),
                F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
            if seen["hits"]:
                return scratch.save(level.filter(hits).distinct(), "hits")
            if seen["nodes"] == 0:
                return empty
            reached, n_nodes = reached.select("node_id", "ready_at"), seen["nodes"]
        return empty
    finally:
        if layout:
            layout.release()
