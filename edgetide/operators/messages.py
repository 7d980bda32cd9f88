"""Message passing between neighbouring vertices, in synchronous rounds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.operators.edges import vertices as vertex_set
from edgetide.operators.edges import edges_in_window
from edgetide.operators.layout import Layout, lay_out
from edgetide.schema import time_literal, time_type
from edgetide.scratch import Scratch


def aggregate_messages(vertices: DataFrame, edges: Layout, message: Column, combine: Callable[[Column], Column],
                       n_senders: int | None = None) -> DataFrame:
    """(id, msg): the combined messages per receiving vertex.

    ``message`` is built from ``f.<sender column>`` and ``e.<edge column>``; a null message is not sent.
    Messages are combined map-side before the shuffle, so a vertex with many in-edges does not gather them all.
    """
    sent = edges.join(vertices, "id", n_senders).select(F.col("e.dst").alias("id"), message.alias("msg"))
    sent = sent.filter("msg IS NOT NULL")
    return sent.groupBy("id").agg(combine(F.col("msg")).alias("msg"))


def message_rounds(
    vertices: DataFrame,
    edges: DataFrame,
    column: str,
    message: Column,
    combine: Callable[[Column], Column],
    update: Callable[[Column, Column], Column],
    max_rounds: int = 50,
    **layout_options,
) -> DataFrame:
    """Run up to ``max_rounds`` rounds on ``column`` of ``vertices`` (id, column); ends early when nothing changes.

    In each round the vertices that changed in the last one send ``message`` along their out-edges, and every
    receiver sets ``column`` to ``update(old value, combined message)``. All messages use last round's values.
    """
    scratch = Scratch(vertices.sparkSession)
    changes = F.coalesce(F.sum(F.col("changed").cast("long")), F.lit(0)).alias("changes")
    state, seen = scratch.save_counted(
        vertices.select("id", column, F.col(column).isNotNull().alias("changed")), "round-0", changes)
    layout = lay_out(edges, "src", ["dst"], [], scratch, **layout_options)
    for number in range(1, max_rounds + 1):
        if seen["changes"] == 0:
            break
        senders = state.filter("changed").select("id", column)
        received = aggregate_messages(senders, layout, message, combine, seen["changes"])
        old, new = F.col(f"s.{column}"), update(F.col(f"s.{column}"), F.col("m.msg"))
        new = F.when(F.col("m.msg").isNotNull(), new).otherwise(old)
        state, seen = scratch.save_counted(
            state.alias("s").join(received.alias("m"), "id", "left").select(
                "id", new.alias(column), (~new.eqNullSafe(old)).alias("changed")),
            f"round-{number}", changes)
        scratch.drop(f"round-{number - 1}")
    layout.release()
    return state.select("id", column)


def reach_hop_bounded(edges: DataFrame, node_id: int, start: str | datetime, hours: int, k: int = 50,
                      **layout_options) -> DataFrame:
    """Earliest arrival (node_id, arrival_time) over at most ``k`` edges; the start node is always included."""
    begin = time_literal(start, time_type(edges, "sent_at"))
    window = edges_in_window(edges, start, hours).select("src", "dst", "sent_at")
    seed = edges.sparkSession.range(1).select(F.lit(node_id).cast("long").alias("node_id"))
    everyone = vertex_set(window).union(seed).distinct().select(
        F.col("node_id").alias("id"), F.when(F.col("node_id") == node_id, begin).alias("arrival_time"))
    reached = message_rounds(
        everyone, window, "arrival_time",
        message=F.when(F.col("e.sent_at") >= F.col("f.arrival_time"), F.col("e.sent_at")),
        combine=F.min, update=F.least, max_rounds=k, **layout_options)
    return reached.filter("arrival_time IS NOT NULL").select(F.col("id").alias("node_id"), "arrival_time")
