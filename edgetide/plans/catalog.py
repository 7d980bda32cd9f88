"""The graph tables in the session catalog: create, append, report, export, drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.operators.layout import BROADCAST_ROWS
from edgetide.schema import DAY, EDGES, PERSON, REJECTS, TWO_HOP
from edgetide.scratch import Scratch

# name -> (schema, key it is bucketed on, order inside the buckets, column that identifies a row)
TABLES = {
    "person": (PERSON, "node_id", ["node_id"], "node_id"),
    "edges": (EDGES, "src", ["src", "sent_at"], "edge_id"),
    "two_hop_index": (TWO_HOP, "n1", ["n1", "t1"], None),
    "mail_rejects": (REJECTS, "path", ["path"], "path"),
}


def create_database(spark: SparkSession, db: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}{where}")
    spark.sql(f"USE {db}")


def create_table(spark: SparkSession, db: str, table: str, buckets: int = 16, table_format: str = "parquet",
                 by_day: bool = False) -> None:
    """Create one of the graph tables. ``buckets`` should grow with the table (about one per GB); 0 leaves it unbucketed.

    ``by_day`` also partitions the edges by the day they were sent, for tables of many days whose buckets are small then.

    With Iceberg on the class path ``table_format="iceberg"`` makes the buckets a partition transform.
    """
    schema, key, order, _ = TABLES[table]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    layout, by_day = "", by_day and table == "edges"
    if buckets and table_format == "iceberg":
        layout = f"PARTITIONED BY (bucket({buckets}, {key}){', days(sent_at)' if by_day else ''})"
    elif by_day:
        columns, layout = f"{columns}, {DAY} date", f"PARTITIONED BY ({DAY}) "
    if buckets and table_format != "iceberg":
        layout += f"CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{table} ({columns}) USING {table_format} {layout}")
    if table_format == "iceberg":
        spark.sql(f"ALTER TABLE {db}.{table} WRITE ORDERED BY {', '.join(order)}")


def create_tables(spark: SparkSession, db: str, buckets: int = 16, table_format: str = "parquet", by_day: bool = False) -> DataFrame:
    create_database(spark, db)
    for table in TABLES:
        create_table(spark, db, table, buckets, table_format, by_day)
    return spark.sql(f"SHOW TABLES IN {db}")


def append(df: DataFrame, db: str, table: str) -> None:
    """Append the rows whose key the table does not have yet, so that a second run adds nothing.

    Of a table partitioned by day only the days of the new rows are read for that, and a key is looked for in its day:
    the id of an edge is hashed from its time, too. Of other tables the keys are read, filtered by those of the new
    rows where these are few.

    The rebalance hint brings the rows of a bucket together, to write few files, and lets Spark split a bucket that
    is too large for one task.
    """
    schema, key, _, identity = TABLES[table]
    spark = df.sparkSession
    if "created_at" in schema.names and "created_at" not in df.columns:
        df = df.withColumn("created_at", F.current_timestamp())
    rows = df.select([F.col(f.name).cast(f.dataType) for f in schema])
    if identity:
        scratch = Scratch(spark)
        rows = scratch.save(rows.dropDuplicates([identity]), "load")  # its keys are looked at first
        stored = spark.table(f"{db}.{table}")
        if DAY in stored.columns:
            rows = rows.withColumn(DAY, F.to_date("sent_at"))
            stored = stored.filter(_days_of(rows))
            on = F.col("n." + identity).eqNullSafe(F.col("k." + identity)) & F.col(f"n.{DAY}").eqNullSafe(F.col(f"k.{DAY}"))
            rows = rows.alias("n").join(stored.select(identity, DAY).alias("k"), on, "left_anti")
        else:
            known = stored.select(identity)
            few = rows.select(identity).limit(BROADCAST_ROWS + 1)
            if few.count() <= BROADCAST_ROWS:
                known = known.join(F.broadcast(rows.select(identity)), identity, "left_semi")
            rows = rows.join(known, identity, "left_anti").select(schema.names)
    rows.hint("rebalance", key).write.insertInto(f"{db}.{table}")
    if identity:
        scratch.close()


def _days_of(rows: DataFrame):
    """A filter for the days from the first to the last of the rows, or without a day."""
    first, last, undated = rows.agg(F.min(DAY), F.max(DAY), F.count_if(F.col(DAY).isNull())).first()
    days = F.col(DAY).between(F.lit(first), F.lit(last)) if first else F.lit(False)
    return days | F.col(DAY).isNull() if undated else days


def overwrite(df: DataFrame, db: str, table: str) -> None:
    """Replace the table's rows."""
    schema, key, _, _ = TABLES[table]
    rows = df.select([F.col(f.name).cast(f.dataType) for f in schema])
    if DAY in df.sparkSession.table(f"{db}.{table}").columns:
        rows = rows.withColumn(DAY, F.to_date("sent_at"))
    rows.hint("rebalance", key).write.insertInto(f"{db}.{table}", overwrite=True)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each given table."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def table_report(spark: SparkSession, db: str) -> DataFrame:
    """(table_name, column_name, data_type, position, row_count) of the graph tables that exist in ``db``."""
    found = {t: spark.table(f"{db}.{t}") for t in TABLES if spark.catalog.tableExists(f"{db}.{t}")}
    columns = spark.createDataFrame(
        [(t, f.name, f.dataType.simpleString(), i) for t, df in found.items() for i, f in enumerate(df.schema, 1)],
        "table_name string, column_name string, data_type string, position int")
    if not found:
        return columns.withColumn("row_count", F.lit(None).cast("long"))
    return columns.join(row_counts(found), "table_name")


def table_properties(spark: SparkSession, db: str, table: str) -> DataFrame:
    return spark.sql(f"SHOW TBLPROPERTIES {db}.{table}")


def sample_rows(spark: SparkSession, db: str, table: str, n: int = 10) -> DataFrame:
    return spark.table(f"{db}.{table}").limit(n)


def export_csv(spark: SparkSession, db: str, folder: str, single_file: bool = False) -> None:
    """Person and edges as CSV with a header line; ``single_file`` is for small tables, it writes in one task."""
    for table in ("person", "edges"):
        df = spark.table(f"{db}.{table}")
        (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(f"{folder}/{table}")


def drop_tables(spark: SparkSession, db: str) -> None:
    for table in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {db}.{table}")
