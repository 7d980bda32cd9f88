"""Graphs derived from star-schema Parquet tables: an event graph, a trade graph, and mail rendered from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def event_edges(events: DataFrame) -> DataFrame:
    """user -> the ``k`` of the event's properties, at the event's time; self loops are left out."""
    return events.select(
        F.col("event_id").cast("string").alias("edge_id"),
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("bigint").alias("dst"),
        F.col("event_type").alias("edge_type"),
        F.col("ts").alias("sent_at"),
    ).filter("src <> dst")


def trade_edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """customer -> supplier when an order is placed, supplier -> customer when a line of it is shipped.

    Customers have even node ids, suppliers odd ones. Many edges share the same day.
    """
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    customer, supplier = F.col("o_custkey") * 2, F.col("l_suppkey") * 2 + 1
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")

    # columns that nobody asks for are not made, as they would be in an array of whole edges
    ordered = F.col("edge_type") == "ORDER"
    return lines.withColumn("edge_type", F.explode(F.array(F.lit("ORDER"), F.lit("SHIP")))).select(
        F.concat("edge_type", F.lit("-"), line).alias("edge_id"),
        F.when(ordered, customer).otherwise(supplier).alias("src"),
        F.when(ordered, supplier).otherwise(customer).alias("dst"),
        "edge_type",
        F.when(ordered, F.col("o_orderdate")).otherwise(F.col("l_shipdate")).alias("sent_at"))


def trade_persons(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    return customer.select((F.col("c_custkey") * 2).alias("node_id"), F.col("c_name").alias("email")).unionByName(
        supplier.select((F.col("s_suppkey") * 2 + 1).alias("node_id"), F.col("s_name").alias("email")))


def order_mail(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(path, content): one rendered message per order, from its customer to the suppliers of its lines.

    Lines shipped with flag R go to To, A to X-cc, N to X-bcc; an order without an R line, or without any, has no To address.
    """
    def suppliers(flag: str):
        lines = F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "l_suppkey")))
        return F.array_join(F.transform(F.sort_array(lines), lambda x: F.concat(
            F.lit("Supplier"), x["l_suppkey"].cast("string"), F.lit("@X.test"))), ",\n\t")

    # An order has at most a handful of lines. Both sides are shuffled, also when one is small: were the boxes broadcast,
    # all messages would be rendered and read in as many tasks as the orders have files.
    boxes = lineitem.groupBy("l_orderkey").agg(*(suppliers(f).alias(f) for f in ("R", "A", "N")))
    return orders.join(boxes.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("maildir/"), F.col("o_orderkey").cast("string"), F.lit(".")).alias("path"),
        F.concat(
            F.lit("Message-ID: <"), F.col("o_orderkey").cast("string"), F.lit("@x.test>\n"),
            F.lit("Date: "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" -0700 (PDT)\n"),
            F.lit("From:  Customer"), F.col("o_custkey").cast("string"), F.lit("@X.test \nTo: "), F.coalesce("R", F.lit("")),
            F.lit("\nX-cc: "), F.coalesce("A", F.lit("")), F.lit("\nX-bcc: "), F.coalesce("N", F.lit("")),
            F.lit("\n\nTo: nobody@x.test\n"), F.col("o_orderpriority")).alias("content"))
