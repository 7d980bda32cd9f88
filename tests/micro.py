"""Small graphs with known answers, and plain-Python answers for random ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

MIDNIGHT = datetime(2024, 1, 1)
EDGE_SCHEMA = "edge_id string, src bigint, dst bigint, sent_at timestamp_ntz"

# (src, dst, minute): nodes 1..6, window 0..10, start 1 at 0
M1 = [(1, 2, 1), (2, 3, 2), (1, 3, 5), (3, 4, 2), (3, 4, 3), (4, 1, 4), (2, 5, 0), (5, 6, 9), (5, 6, 10)]


def at(minute: float) -> datetime:
    return MIDNIGHT + timedelta(minutes=minute)


def minute_of(moment: datetime) -> int:
    return int((moment - MIDNIGHT).total_seconds() // 60)


def edge_frame(spark, edges, partitions: int = 3):
    rows = [(f"e{i:05d}", s, d, at(m)) for i, (s, d, m) in enumerate(edges)]
    return spark.createDataFrame(rows, EDGE_SCHEMA).repartition(partitions)


def source_frame(spark, rows):
    """rows: (source_id, node_id, first minute, last minute)"""
    return spark.createDataFrame(
        [(g, n, at(a), at(b)) for g, n, a, b in rows],
        "source_id bigint, node_id bigint, start_time timestamp_ntz, window_end timestamp_ntz")


def random_graph(rng: random.Random, offset: int, nodes: int = 7, edges: int = 16, minutes: int = 6):
    found = []
    for _ in range(rng.randint(1, edges)):
        s, d = rng.sample(range(nodes), 2)
        found.append((offset + s, offset + d, rng.randint(0, minutes)))
    return found


def brute_reach(edges, start, first, last, strict=False, max_edges=None):
    """Repeats single synchronous rounds over all edges until nothing changes."""
    best = {start: first}
    rounds = 0
    while max_edges is None or rounds < max_edges:
        rounds += 1
        new = dict(best)
        for s, d, m in edges:
            if s in best and first <= m <= last and (m > best[s] if strict else m >= best[s]):
                new[d] = min(new.get(d, m), m)
        if new == best:
            break
        best = new
    return best


def brute_index(edges, strict=True):
    best = {}
    for n1, n2, t1 in edges:
        for s, n3, t2 in edges:
            if s == n2 and (t1 < t2 if strict else t1 <= t2):
                key = (n1, t1, n2, n3)
                best[key] = min(best.get(key, t2), t2)
    return {(n1, t1, n2, t2, n3) for (n1, t1, n2, n3), t2 in best.items()}
