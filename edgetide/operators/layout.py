"""Physical layout of an edge set that is joined on the same key round after round."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgetide.scratch import Scratch

ROWS_PER_PARTITION = 2_000_000
MAX_PARTITIONS = 20_000
# Below ROWS_PER_PARTITION times the cores, partitions get this many rows so that all cores take part.
ROWS_PER_CORE = 50_000
# A frontier row is below 64 bytes, so a broadcast of this many rows stays below 13 MB.
BROADCAST_ROWS = 200_000
# Up to this many frontier keys are written into the scan filter of a large edge set.
PRUNE_KEYS = 1_000
PRUNE_ROWS = 50_000_000


def hot_limit(rows: int, partitions: int, floor: int = ROWS_PER_PARTITION) -> int:
    """Rows one key may hold before it is split: four average partitions, and never less than ``floor``."""
    return max(floor, 4 * ceil(rows / partitions))


def hot_keys(counts: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys above ``limit`` rows and the number of pieces each is split into."""
    return counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("fan"))


def salt_of(spread_by: list[str], fan: Column) -> Column:
    return F.pmod(F.xxhash64(*spread_by), fan).cast("int")


@dataclass(frozen=True)
class Layout:
    """Rows hash-partitioned on their key, sorted within partitions and persisted.

    Spark keeps the partitioning and the order of a persisted DataFrame, so a join on the key neither shuffles nor
    sorts this side again. ``fan`` lists the hot keys, if there are any: their rows are spread over several salts, and
    the key is then (key, salt).
    """

    rows: DataFrame
    key: str
    total: int
    fan: DataFrame | None

    def salted(self, keys: DataFrame, column: str) -> DataFrame:
        """Give each key row its salts: one for an ordinary key, ``fan`` copies for a hot one."""
        if self.fan is None:
            return keys
        fan = self.fan.withColumnRenamed(self.key, column)
        return (
            keys.join(F.broadcast(fan), column, "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)))
            .drop("fan")
        )

    def join(self, keys: DataFrame, column: str, n_keys: int | None, condition: str = "true") -> DataFrame:
        """Join the rows, as ``e``, with ``keys``, as ``f``, on ``column`` and ``condition``.

        ``n_keys`` is the measured number of key rows; when it is small they are broadcast. Otherwise, or when it is
        not known, they are shuffled to where the rows are.
        """
        side, rows = self.salted(keys, column), self.rows
        if n_keys is not None and n_keys <= BROADCAST_ROWS:
            side = F.broadcast(side)
        if n_keys is not None and n_keys <= PRUNE_KEYS and self.total >= PRUNE_ROWS:
            # at most PRUNE_KEYS values: sorted batches without any of them are skipped by their min/max
            found = [r[0] for r in keys.select(column).distinct().collect()]
            rows = rows.filter(F.col(self.key).isin(found))
        on = f"e.{self.key} = f.{column}" + ("" if self.fan is None else " AND e.salt = f.salt")
        return rows.alias("e").join(side.alias("f"), F.expr(f"{on} AND {condition}"))

    def release(self) -> None:
        self.rows.unpersist()


@dataclass(frozen=True)
class Measured:
    counts: DataFrame
    total: int
    top: int


def measure(df: DataFrame, key: str) -> Measured:
    """Rows per key, of which only the sum and the maximum come to the driver."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return Measured(counts, total, top)


def partitions_on(df: DataFrame, key: str) -> int | None:
    """The number of partitions if the rows come hash-partitioned on ``key``, as from a table bucketed on it; else None."""
    found = re.fullmatch(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", df._jdf.queryExecution().sparkPlan().outputPartitioning().toString())
    return int(found[2]) if found and found[1] == key else None


def computed(df: DataFrame) -> bool:
    """Whether reading the rows takes more than a scan with filters and projections."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(step in plan for step in ("Join", "Aggregate", "Generate", "Window", "Sort", "Repartition"))


def lay_out(
    df: DataFrame,
    key: str,
    spread_by: list[str],
    order_by: list[str],
    scratch: Scratch,
    measured: Measured | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
    hot_floor: int = ROWS_PER_PARTITION,
    collapse: bool = False,
) -> Layout:
    """Partition ``df`` for repeated joins on ``key``, splitting keys that hold too many rows.

    With ``collapse`` equal rows are kept once; of those that differ in ``edge_id`` only, the one with the least.
    They meet in the partition of their key, so that takes no shuffle of its own. Rows of a table that is bucketed on
    the key stay in their buckets, unless those are too large or a key is hot.

    ``limit >= 4 * total / partitions``, so at most ``partitions / 4`` <= 5,000 keys can be hot: that bounds the
    broadcast of the hot list.
    """
    measured = measured or measure(df, key)
    cores = min(df.sparkSession.sparkContext.defaultParallelism, ceil(measured.total / ROWS_PER_CORE))
    partitions = min(MAX_PARTITIONS, max(2, cores, ceil(measured.total / rows_per_partition)))
    limit = hot_limit(max(measured.total, 1), partitions, hot_floor)
    fan, salt = None, []
    if measured.top > limit:
        fan, salt = scratch.save(hot_keys(measured.counts, key, limit), f"hot-{key}"), ["salt"]
        df = df.join(F.broadcast(fan), key, "left").withColumn("salt", salt_of(spread_by, F.coalesce("fan", F.lit(1))))
    buckets = partitions_on(df, key) if collapse and fan is None else None
    if buckets and measured.total <= buckets * limit:
        rows = df
    else:
        rows = df.drop("fan").repartition(partitions, key, *salt)
    if collapse and "edge_id" in rows.columns:
        rows = rows.groupBy([c for c in rows.columns if c != "edge_id"]).agg(F.min("edge_id").alias("edge_id"))
    elif collapse:
        # equal rows lie next to each other in the order that is kept anyway, so no table of all rows is hashed
        rest = [c for c in rows.columns if c not in (key, *salt, *order_by)]
        run = Window.partitionBy(key, *salt).orderBy(*order_by, *rest)
        repeats = [F.lag(c).over(run).eqNullSafe(F.col(c)) for c in (*order_by, *rest)]
        first = F.row_number().over(run) == 1
        rows = rows.withColumn("repeats", ~first & reduce(and_, repeats)).filter("NOT repeats").drop("repeats")
    rows = rows.sortWithinPartitions(key, *salt, *order_by).persist(StorageLevel.MEMORY_AND_DISK)
    return Layout(rows, key, measured.total, fan)


def spread_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread_by: list[str],
    scratch: Scratch,
    measured: Measured | None = None,
    partitions: int | None = None,
    hot_floor: int = ROWS_PER_PARTITION,
) -> DataFrame:
    """Inner join of many ``facts`` with few ``dim`` rows per key.

    Facts whose first key column holds too many rows are spread over several salts, and the dim rows of those keys
    are copied to each salt. ``measured`` saves the count of the facts when it is known already.
    """
    key = on[0]
    measured = measured or measure(facts, key)
    partitions = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = hot_limit(max(measured.total, 1), partitions, hot_floor)
    if measured.top <= limit:
        return facts.join(dim, on)
    # at most total / limit <= partitions / 4 hot keys
    fan = F.broadcast(scratch.save(hot_keys(measured.counts, key, limit), f"hot-{key}-{uuid.uuid4().hex}"))
    salted = facts.join(fan, key, "left").withColumn("salt", salt_of(spread_by, F.coalesce("fan", F.lit(1)))).drop("fan")
    copies = dim.join(fan, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1))).drop("fan")
    return salted.join(copies, [*on, "salt"]).drop("salt")
