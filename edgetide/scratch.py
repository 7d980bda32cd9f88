"""Intermediate tables in the shared checkpoint folder.

Loops cut their lineage by writing each step as Parquet into the folder named by ``spark.checkpoint.dir`` and
reading it back. One write is one job, row counts come out of that same job, and a lost executor costs nothing
that was written. ``drop`` releases a step that a later one has replaced; whoever owns the run calls ``close`` when
its result has been used. What nobody closes is left to the folder's own cleaning, as with Spark's ``checkpoint()``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, one below the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


class Scratch:
    """One folder per run; ``save`` writes a step and hands back a DataFrame that reads it."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark = spark
        self.base = base or f"{checkpoint_root(spark)}/edgetide/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read_all(self, names: list[str], schema) -> DataFrame:
        """Several steps of the same schema as one scan."""
        return self.spark.read.schema(schema).parquet(*(self.path(name) for name in names))

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df.schema)

    def save_counted(self, df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
        """As ``save``; the metrics are observed by the writing tasks themselves, so there is no second job."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        saved = self.save(df.observe(seen, *metrics), name)
        return saved, seen.get

    def drop(self, name: str) -> None:
        """Release a step that nothing reads any more."""
        self._delete(self.path(name))

    def close(self) -> None:
        """Release the whole run; DataFrames that read it are of no use afterwards."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
