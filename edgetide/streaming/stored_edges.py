"""The edges a stream has accepted, by bucket of their source node.

``edges/step=bN/bucket=B`` holds the edges of batch N, sorted by time. After every GROUP_BATCHES batches those are
written together as ``edges/step=cG``, once: a later group is a folder of its own, so that an edge is written three
times in all (as it comes, by bucket, in its group). Which folders make up the edges after a batch follows from its
number alone, so a replayed batch reads what its first run read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgetide.operators.layout import BROADCAST_ROWS, Layout, lay_out
from edgetide.schema import from_micros
from edgetide.scratch import Scratch

GROUP_BATCHES = 16
# Reading all buckets so many times costs about as much as laying the edges out once by a shuffle.
LAY_OUT_READS = 3


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


def steps_of(batch_id: int) -> list[str]:
    """The folders that hold the edges of all batches up to this one."""
    groups = batch_id // GROUP_BATCHES
    return [f"c{g}" for g in range(groups)] + [f"b{n}" for n in range(groups * GROUP_BATCHES, batch_id + 1)]


@dataclass
class StoredEdges:
    """``schema`` is that of the edges: src, start_time, end_time, dst. The number of buckets is fixed for good by the first batch."""

    scratch: Scratch
    schema: T.StructType
    buckets: int

    def __post_init__(self):
        context = self.scratch.spark.sparkContext
        pattern = context._jvm.org.apache.hadoop.fs.Path(f"{self.scratch.path('edges')}/of=*")
        there = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern) or []
        other = [f.getPath().getName() for f in there if f.getPath().getName() != f"of={self.buckets}"]
        if other:
            raise ValueError(f"the edges are stored in other buckets already: {other[0]}, not of={self.buckets}")
        self.base = f"edges/of={self.buckets}"

    def _write(self, edges: DataFrame, step: str) -> None:
        edges = edges.select(*self.schema.names, bucket_of("src", self.buckets).alias("bucket"))
        # a task writes few buckets, and a large bucket is written by several
        edges = edges.hint("rebalance", "bucket").sortWithinPartitions("bucket", "start_time")
        edges.write.mode("overwrite").partitionBy("bucket").parquet(self.scratch.path(f"{self.base}/step={step}"))

    def _read(self, steps: list[str]) -> DataFrame:
        found = T.StructType([*self.schema.fields, T.StructField("step", T.StringType()), T.StructField("bucket", T.IntegerType())])
        reader = self.scratch.spark.read.schema(found).option("basePath", self.scratch.path(self.base))
        return reader.parquet(*(self.scratch.path(f"{self.base}/step={s}") for s in steps)).drop("step")

    def add(self, edges: DataFrame, batch_id: int) -> DataFrame:
        """Store the edges of a batch; hands back a DataFrame that reads them."""
        if batch_id % GROUP_BATCHES == 0 and batch_id:
            self._write(self._read([f"b{n}" for n in range(batch_id - GROUP_BATCHES, batch_id)]),
                        f"c{batch_id // GROUP_BATCHES - 1}")
        if batch_id % GROUP_BATCHES == 1 and batch_id > 1:
            # the batch before is done for good, so nobody reads these again
            for number in range(batch_id - GROUP_BATCHES - 1, batch_id - 1):
                self.scratch.drop(f"{self.base}/step=b{number}")
        self._write(edges, f"b{batch_id}")
        return self._read([f"b{batch_id}"]).drop("bucket")

    def since(self, batch_id: int, first: int, time) -> "Touched":
        """The edges of all batches up to this one that leave at ``first`` (microseconds) or later."""
        edges = self._read(steps_of(batch_id)).filter(F.col("start_time") >= from_micros(first, time))
        return Touched(edges, self.buckets, self.scratch)


@dataclass
class Touched:
    """Joins like a ``Layout``, without laying the edges out.

    A round reads only the buckets of its frontier and, as a small frontier is broadcast, moves no edge. Rounds that
    together have read all edges LAY_OUT_READS times, or a frontier too large to broadcast, are followed by a layout:
    so the cost is at most about twice that of the better way, which cannot be known in advance.
    """

    edges: DataFrame
    buckets: int
    scratch: Scratch
    read: int = 0
    touched: list[list[int]] = field(default_factory=list)
    laid: Layout | None = None

    def join(self, keys: DataFrame, column: str, n_keys: int | None, condition: str = "true") -> DataFrame:
        small = n_keys is not None and n_keys <= BROADCAST_ROWS
        if self.laid is None and small and self.read < LAY_OUT_READS * self.buckets:
            # one row with at most as many numbers as there are buckets
            found = sorted(keys.agg(F.collect_set(bucket_of(column, self.buckets))).first()[0])
            self.touched.append(found)
            self.read += len(found)
            near = self.edges.filter(F.col("bucket").isin(found)).drop("bucket")
            return near.alias("e").join(F.broadcast(keys).alias("f"), F.expr(f"e.src = f.{column} AND {condition}"))
        if self.laid is None:
            self.laid = lay_out(self.edges.drop("bucket"), "src", ["dst", "start_time"], ["start_time"], self.scratch, collapse=True)
        return self.laid.join(keys, column, n_keys, condition)

    def release(self) -> None:
        if self.laid is not None:
            self.laid.release()
