"""Earliest arrivals kept up to date over a stream of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgetide.operators.layout import BROADCAST_ROWS, Layout, lay_out
from edgetide.operators.known import KEYS, Known
from edgetide.operators.reach import candidates, relax, seed_state, total_rows
from edgetide.schema import micros, time_type
from edgetide.scratch import Scratch
from edgetide.streaming.stored_edges import StoredEdges, Touched

# After so many batches the state is written as a whole, so that it never takes more folders than this to read it.
SNAPSHOT_BATCHES = 16


@dataclass
class ReachStream:
    """Stream job whose state after each micro-batch equals ``reach`` over all edges accepted so far.

    Folders below ``base``: ``edges`` holds the accepted edges (``StoredEdges``), ``state/N`` the arrivals that batch N
    has improved, or all of them where N is a multiple of SNAPSHOT_BATCHES. Batch N reads what the batches before it
    wrote and writes both with overwrite, so a replayed batch changes nothing. New edges only ever lower arrivals: a
    batch joins its edges with the state of their source nodes, and only what improves is carried on through the stored
    edges, of which a round reads the buckets of the improved nodes, from the first improved arrival on. What is known
    stays laid out from batch to batch, each adding a layer; a restart and every snapshot lay it out anew.
    """

    spark: SparkSession
    sources: DataFrame
    base: str | None = None
    late: str = "1 hour"
    strict: bool = False
    # partitions of the stream's own state, which holds the edge ids seen; fixed for good by the first start
    partitions: int | None = None
    # folders that the stored edges of a batch are cut into by source node; fixed for good by the first start
    buckets: int = 16

    def __post_init__(self):
        self.scratch = Scratch(self.spark, self.base)
        self.base = self.scratch.base
        self.time = time_type(self.sources, "start_time")
        self.last_batch = self._stored_batch()
        self.seeds = self.scratch.save(seed_state(self.sources), "seeds")
        self.edges: StoredEdges | None = None
        self.known: Known | None = None
        self.known_batch = None
        self.walked: Touched | None = None

    def start(self, edges: DataFrame, **trigger) -> StreamingQuery:
        """``edges`` is a streaming (edge_id, src, dst, sent_at). Later than ``late`` behind the newest edge, or with
        an edge id seen within that time, an edge is dropped."""
        accepted = (
            edges.select("edge_id", "src", "dst", F.col("sent_at").cast("timestamp").alias("sent_at"))
            .filter("src <> dst")
            .withWatermark("sent_at", self.late)
            .dropDuplicatesWithinWatermark(["edge_id"])
            .select("src", "dst", F.col("sent_at").cast(self.time).alias("sent_at"))
        )
        writer = accepted.writeStream.outputMode("append").option("checkpointLocation", f"{self.base}/progress")
        writer = writer.foreachBatch(self.process).trigger(**(trigger or {"availableNow": True}))
        setting = "spark.sql.shuffle.partitions"
        before = self.spark.conf.get(setting)
        # a starting stream takes the setting with it
        self.spark.conf.set(setting, str(self.partitions or before))
        try:
            return writer.start()
        finally:
            self.spark.conf.set(setting, before)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        # A stream's own session runs without adaptive execution and cuts a batch into as many pieces as the stream has
        # state partitions. So the batch is stored as it comes, and all else runs in the caller's session.
        arrived = batch.selectExpr("src", "sent_at AS start_time", "sent_at AS end_time", "dst")
        arrived = self.scratch.read(self._stored(arrived, batch_id), arrived.schema)
        if self.edges is None:
            self.edges = StoredEdges(self.scratch, arrived.schema, self.buckets)
        new = self.edges.add(arrived, batch_id)
        known = self._known_before(batch_id)
        n_before, self.walked = len(known.saved), None
        try:
            layout = lay_out(new, "src", ["dst", "start_time"], ["start_time"], self.scratch, collapse=True)
            if layout.total:
                self._update(known, layout, batch_id)
            layout.release()
            whole = batch_id and batch_id % SNAPSHOT_BATCHES == 0
            more = len(known.saved) > n_before
            improved = known.rows() if whole else known.rows(since=n_before) if more else self.seeds.limit(0)
            self.scratch.save(improved, f"state/{batch_id}")
            if more:
                known.saved[n_before:] = [f"state/{batch_id}"]
        except BaseException:
            known.close()
            raise
        if whole:
            # the layers can be computed again from the steps of their batches only, so those stay until here
            known.close()
            for number in range(batch_id - SNAPSHOT_BATCHES, batch_id + 1):
                self.scratch.drop(f"work/{number}")
        else:
            self.known, self.known_batch = known, batch_id
        self.last_batch = batch_id

    def _known_before(self, batch_id: int) -> Known:
        """What is known before a batch: as the batch before has left it, or read back."""
        known, self.known = self.known, None
        if known is not None and self.known_batch == batch_id - 1:
            return known
        if known is not None:
            known.close()
        return self._known(batch_id - 1)

    def _stored(self, arrived: DataFrame, batch_id: int) -> str:
        name = f"work/{batch_id}/arrived"
        arrived.write.mode("overwrite").parquet(self.scratch.path(name))
        return name

    def _update(self, known: Known, new: Layout, batch_id: int) -> None:
        state = known.rows()
        if new.total <= BROADCAST_ROWS:
            # the state of the nodes that the new edges leave, found without a shuffle of all of it
            state = known.rows(nodes=F.broadcast(new.rows.select(F.col("src").alias("node_id")).distinct()))
        unused = state.withColumn("prev_time", F.lit(None).cast(self.time))
        first = F.min(micros(F.col("arrival_time"))).alias("first")
        name = f"work/{batch_id}/first"
        improved, seen = self.scratch.save_counted(
            known.improved(candidates(new, unused, known.total(), self.strict)), name, total_rows(), first)
        if not seen["total"]:
            return
        known.add(name, seen["total"])
        # From a node's old arrival on, all edges are used: the stored ones by earlier batches, the new ones just
        # now. What is left are edges between its new and its old arrival, which is what ``relax`` looks at.
        if not batch_id:
            relax(new, known, improved, seen["total"], f"work/{batch_id}/more", self.strict)
            return
        self.walked = self.edges.since(batch_id, seen["first"], self.time)
        relax(self.walked, known, improved, seen["total"], f"work/{batch_id}/more", self.strict)
        self.walked.release()

    def _stored_batch(self) -> int:
        """The last batch whose state was written as a whole, so that a restarted stream goes on from there; else -1."""
        context = self.spark.sparkContext
        pattern = context._jvm.org.apache.hadoop.fs.Path(f"{self.base}/state/*/_SUCCESS")
        found = pattern.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(pattern)
        return max((int(f.getPath().getParent().getName()) for f in found or []), default=-1)

    def _written(self, batch_id: int) -> list[str]:
        """The folders that make up the state after a batch; before batch 0 there are only the start nodes."""
        whole = batch_id - batch_id % SNAPSHOT_BATCHES if batch_id >= 0 else 0
        start = [] if whole else ["seeds"]
        return start + [f"state/{n}" for n in range(whole, batch_id + 1)]

    def _known(self, batch_id: int) -> Known:
        names = self._written(batch_id)
        return Known.of(self.scratch, names, self.seeds.schema, self.scratch.read_all(names, self.seeds.schema).count())

    def _state(self, batch_id: int) -> DataFrame:
        known = self._known(batch_id)
        known.close()
        return known.rows()

    def arrivals(self, batch_id: int | None = None) -> DataFrame:
        """(source_id, node_id, arrival_time) after a batch, by default the last one processed, also by a stream before a restart."""
        batch_id = self.last_batch if batch_id is None else batch_id
        return self._state(batch_id).select(*KEYS, "arrival_time")
