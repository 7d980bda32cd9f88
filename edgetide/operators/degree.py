"""Degrees per node and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def degree(edges: DataFrame) -> DataFrame:
    """Out-, in- and total degree per node; nodes without edges are absent, a missing side counts 0.

    Each edge gives one row per end in a single scan. The partial sums run before the only shuffle, so a hub
    sends one row per task, not one per edge.
    """
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("node_id"), F.lit(1).cast("long").alias("sent"), F.lit(0).cast("long").alias("got")),
        F.struct(F.col("dst").alias("node_id"), F.lit(0).cast("long").alias("sent"), F.lit(1).cast("long").alias("got")),
    )))
    return (
        ends.groupBy("node_id")
        .agg(F.sum("sent").alias("out_degree"), F.sum("got").alias("in_degree"))
        .withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))
    )


def degree_stats(edges: DataFrame) -> DataFrame:
    return degree(edges).agg(F.avg("total_degree").alias("avg_degree"), F.max("total_degree").alias("max_degree"))
