"""Reachability in SQL: one statement for each round, to the fixpoint."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.operators.edges import edges_in_window
from edgetide.scratch import Scratch


def reach_recursive_sql(edges: DataFrame, node_id: int, start: str | datetime, hours: int) -> DataFrame:
    """(node_id, arrival_time) of all nodes reachable within the window.

    Spark's recursive CTE keeps every distinct (node, time, hop) of all walks, needs a bound on the hops and stops at a
    number of rows. The recursion therefore runs as rounds of one statement that keeps the least arrival of each
    node; it ends by itself when a round improves nothing. An improved node only uses the edges that leave before its
    former arrival, since the later ones were used then.
    """
    spark = edges.sparkSession
    scratch, name = Scratch(spark), uuid.uuid4().hex
    window = scratch.save(edges_in_window(edges, start, hours).select("src", "dst", "sent_at").distinct(), "edges")
    window.createOrReplaceTempView(f"edges_{name}")
    literal = "TIMESTAMP_NTZ" if dict(edges.dtypes)["sent_at"] == "timestamp_ntz" else "TIMESTAMP_LTZ"
    text = start.isoformat(sep=" ") if isinstance(start, datetime) else start.strip().rstrip("Z").replace("T", " ")
    state = spark.sql(f"SELECT CAST({int(node_id)} AS BIGINT) AS node_id, {literal} '{text}' AS arrival_time, "
                      f"CAST(NULL AS {literal}) AS known, true AS changed")
    state, seen, round_ = scratch.save(state, "round-0"), {"changed": 1}, 0
    while seen["changed"]:
        round_ += 1
        state.createOrReplaceTempView(f"state_{name}")
        merged = spark.sql(f"""
            WITH candidates AS (
                SELECT node_id, arrival_time, arrival_time AS known FROM state_{name}
                UNION ALL
                SELECT e.dst, e.sent_at, NULL
                FROM state_{name} s JOIN edges_{name} e
                  ON e.src = s.node_id AND e.sent_at >= s.arrival_time AND (s.known IS NULL OR e.sent_at < s.known)
                WHERE s.changed
            )
            SELECT node_id, MIN(arrival_time) AS arrival_time, MIN(known) AS known,
                   MIN(known) IS NULL OR MIN(arrival_time) < MIN(known) AS changed
            FROM candidates GROUP BY node_id
        """)
        state, seen = scratch.save_counted(merged, f"round-{round_}", F.count_if("changed").alias("changed"))
        if round_ > 1:
            scratch.drop(f"round-{round_ - 2}")
    spark.catalog.dropTempView(f"state_{name}")
    spark.catalog.dropTempView(f"edges_{name}")
    return state.select("node_id", "arrival_time")
