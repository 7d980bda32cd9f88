"""Earliest-arrival paths, walked back over the predecessors kept by the relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetide.operators.known import KEYS
from edgetide.operators.reach import note_limit, reach
from edgetide.scratch import Scratch


def earliest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, **options) -> DataFrame:
    """The nodes of one earliest-arrival path to each target: (source_id, target, step, node_id, edge_id, arrival_time).

    Step 0 is the start node and has no edge. ``targets`` is (node_id); left out, every reached node is a target.
    Warns ``RoundLimit`` if a limit on rounds ended the search.

    All paths are walked back together by doubling. A job turns each node's 2^k-th predecessor into its 2^(k+1)-th, so
    paths of n edges take log2(n) jobs. Then one job puts the paths together: it joins the targets with the predecessors
    1, 2, 4 ... edges back, and each join keeps a row and adds the one it leads to.
    """
    scratch = Scratch(edges.sparkSession)
    found = reach(edges, sources, track_path=True, **options)
    note_limit(found.converged, len(found.rounds))
    tree = scratch.save(found.arrivals, "tree")
    jumps = predecessors(tree, scratch)
    ends = tree if targets is None else tree.join(targets.select("node_id").distinct(), "node_id", "left_semi")
    rows = ends.select("source_id", F.col("node_id").alias("target"), "node_id", F.lit(0).alias("back"))
    for k, jump in enumerate(jumps):
        here = F.struct("node_id", "back")
        there = F.struct(F.col("up").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        rows = rows.join(jump, KEYS, "left").select("source_id", "target", F.inline(
            F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))))
    # a window group is one path: at most one row per hop
    length = F.max("back").over(Window.partitionBy("source_id", "target"))
    path = rows.withColumn("step", length - F.col("back")).join(tree, KEYS)
    return path.select("source_id", "target", "step", "node_id", F.col("via_edge").alias("edge_id"), "arrival_time")


def predecessors(tree: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(source_id, node_id, up) for 1, 2, 4 ... edges back, as long as any node has such a predecessor."""
    jump, seen = scratch.save_counted(
        tree.filter("via_src IS NOT NULL").select(*KEYS, F.col("via_src").alias("up")), "back-0", F.count(F.lit(1)).alias("n"))
    jumps = []
    while seen["n"]:
        jumps.append(jump)
        further = jump.select("source_id", F.col("node_id").alias("at"), F.col("up").alias("higher"))
        jump, seen = scratch.save_counted(
            jump.withColumnRenamed("up", "at").join(further, ["source_id", "at"]).select(*KEYS, F.col("higher").alias("up")),
            f"back-{len(jumps)}", F.count(F.lit(1)).alias("n"))
    return jumps
