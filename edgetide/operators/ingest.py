"""From parsed mail or JSON records to the person and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgetide.functions.mail_text import edge_id
from edgetide.operators.layout import BROADCAST_ROWS, spread_join
from edgetide.scratch import Scratch


def mail_recipients(parsed: DataFrame) -> DataFrame:
    """One row per sender, recipient, role and moment: (sender, recipient, edge_type, sent_at_iso, sent_at)."""
    def role(kind: str, column: str):
        return F.transform(column, lambda a: F.struct(F.lit(kind).alias("edge_type"), a.alias("recipient")))

    rows = parsed.filter("sender <> ''").select(
        "sender", "sent_at_iso", "sent_at",
        F.inline(F.concat(role("TO", "to"), role("CC", "cc"), role("BCC", "bcc"))))
    # the same message in several folders gives its edges once; this also shrinks the joins that follow
    return rows.dropDuplicates(["sender", "recipient", "edge_type", "sent_at_iso"]).select(
        "sender", "recipient", "edge_type", "sent_at_iso", "sent_at")


def person_dim(recipients: DataFrame, scratch: Scratch | None = None, known: DataFrame | None = None) -> DataFrame:
    """(node_id, email): every address once, numbered from 1 in the order of the e-mails.

    Addresses in ``known`` (node_id, email) keep their ids; new ones are numbered from the largest known id on. So an
    address has the same id in every load, and equal edges of different loads have equal hashes.

    The ids are dense without a single-partition window: the sorted addresses are written with their position in
    their range partition, and the partitions' offsets come from one row per partition.
    """
    scratch = scratch or Scratch(recipients.sparkSession)
    emails = recipients.select(F.explode(F.array("sender", "recipient")).alias("email")).distinct()
    largest = 0
    if known is not None:
        known = known.select("node_id", "email")
        largest = known.agg(F.coalesce(F.max("node_id"), F.lit(0)).cast("long")).first()[0]
        emails = emails.join(known.select("email"), "email", "left_anti")
    numbered = scratch.save(
        emails.orderBy("email").select("email", F.monotonically_increasing_id().alias("at")), "emails")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a window over one row per range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    new = numbered.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        (F.col("offset") + row + 1 + largest).alias("node_id"), "email")
    return new if known is None else known.unionByName(new)


def mail_edges(recipients: DataFrame, person: DataFrame, n_persons: int | None = None,
               scratch: Scratch | None = None) -> DataFrame:
    """(edge_id, src, dst, edge_type, sent_at, sent_at_iso); mail to oneself gives no edge.

    Up to BROADCAST_ROWS persons are broadcast. Beyond that both look-ups shuffle on the e-mail, with the addresses
    that hold too many rows spread over several partitions.
    """
    rows = recipients.filter("sender <> recipient AND sent_at_iso IS NOT NULL")
    ids = person.select("node_id", "email")
    n_persons = ids.count() if n_persons is None else n_persons
    if n_persons <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
        rows = rows.join(ids.selectExpr("node_id AS src", "email AS sender"), "sender")
        rows = rows.join(ids.selectExpr("node_id AS dst", "email AS recipient"), "recipient")
    else:
        scratch = scratch or Scratch(recipients.sparkSession)
        rows = spread_join(rows, ids.selectExpr("node_id AS src", "email AS sender"), ["sender"],
                           ["recipient", "sent_at_iso"], scratch)
        rows = spread_join(rows, ids.selectExpr("node_id AS dst", "email AS recipient"), ["recipient"],
                           ["sender", "sent_at_iso"], scratch)
    return rows.select(
        edge_id(F.col("src"), F.col("dst"), F.col("sent_at_iso"), F.col("edge_type")).alias("edge_id"),
        "src", "dst", "edge_type", "sent_at", "sent_at_iso")


def person_flatten(nodes: DataFrame) -> DataFrame:
    """Node records as rows of the person table, without the audit column."""
    return nodes.select(F.col("node_id").cast("bigint").alias("node_id"), F.col("static_props.email").alias("email"))


def edge_flatten(edges: DataFrame) -> DataFrame:
    """Edge records as rows of the edge table, without the audit column; self loops are dropped, bad times are null."""
    return edges.filter("source_id <> target_id").select(
        "edge_id",
        F.col("source_id").cast("bigint").alias("src"),
        F.col("target_id").cast("bigint").alias("dst"),
        "edge_type",
        F.col("static_props.timestamp").try_cast("timestamp").alias("sent_at"))
