"""Sharding by vector bin packing (operator 1).

A group (rows of equal text) is a load vector of bytes, tokens and rows. A group is placed in the shard where the dot
product of its load with the shard's residual capacity is highest (bytes weigh 32, tokens and rows 1), large groups first. Three levels keep every step
bounded:

* Groups above 1/``FINE`` of the total in some dimension: at most 3 * FINE of them, placed one after the other by the
  driver, which sees one vector each. Groups stay whole; only one that no shard can hold, above 1/``shards`` of the
  total, is first cut by doc_id into the fewest pieces that fit, which are placed like groups.
* All others: hashed into cells of about ``CELL`` groups. Each cell is packed in a task of its own against its share of
  the capacity that the large groups left.
* Slots: rows are dealt by (shard, cell of doc_id); a cell's first slot is the number of rows before it.

Defined results: a null text is a group of its own with a size of 1 byte and no tokens; null and repeated doc_ids and
repeated rows are placed like any other; texts of any length are measured whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch, text_key, word_count

SHARDS = 16
FINE = 4096
CELL = 4096
SLOT_ROWS = 20_000
DIMENSIONS = ["bytes", "tokens", "rows"]
WEIGHTS = np.array([32.0, 1.0, 1.0])  # in the dot product; the law is about bytes


def loads() -> list[Column]:
    return [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]


def place(loads: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each load vector, placed in the order of their largest share; ``capacity`` is used up in place.

    Loads and capacities are shares of the total. Of equal dot products the first shard wins.
    """
    shards = np.empty(len(loads), dtype=np.int32)
    for i in np.argsort(-loads.max(axis=1), kind="stable"):
        best = int(np.argmax(capacity @ (WEIGHTS * loads[i])))
        shards[i] = best
        capacity[best] -= loads[i]
    return shards


def shards_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, group, shard, slot) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"),
        word_count(F.col("text")).alias("tokens"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(F.col("text")).alias("group")), "rows")
    groups = scratch.save(rows.groupBy("group").agg(*loads()), "groups")
    totals = groups.agg(F.count(F.lit(1)).alias("groups"), *(F.sum(c).alias(c) for c in DIMENSIONS)).first()
    total = np.array([max(float(totals[c] or 0), 1.0) for c in DIMENSIONS])
    share = F.greatest(*(F.col(c) / F.lit(float(t)) for c, t in zip(DIMENSIONS, total)))

    # a text that fills more than a shard in pieces: at most 3 * shards such groups, each with at most as many pieces
    hot = groups.filter(share > 1 / shards).select("group", F.ceil(share * shards).cast("int").alias("pieces"))
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "pieces")).cast("int")
    rows = rows.join(F.broadcast(hot), "group", "left").withColumn("piece", piece).drop("pieces")
    hot_pieces = rows.join(F.broadcast(hot.select("group")), "group", "left_semi").groupBy("group", "piece").agg(*loads())
    whole = groups.filter((share > 1 / FINE) & (share <= 1 / shards)).select("group", F.lit(0).alias("piece"), *DIMENSIONS)
    large = hot_pieces.unionByName(whole).orderBy("group", "piece").toPandas()
    capacity = np.tile(large[DIMENSIONS].to_numpy(dtype=float).sum(axis=0) / total / shards, (shards, 1))
    small = 1 - capacity.sum(axis=0)
    capacity += np.clip(small, 0, None) / shards
    large["shard"] = place(large[DIMENSIONS].to_numpy(dtype=float) / total, capacity)

    cells = max(1, -(-int(totals["groups"]) // CELL))

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("group", ignore_index=True)
        vectors = cell[DIMENSIONS].to_numpy(dtype=float) / total
        room = np.clip(capacity, 0, None)
        cell["shard"] = place(vectors, room / np.maximum(room.sum(axis=0), 1e-12) * vectors.sum(axis=0))
        return cell[["group", "shard"]]

    packed = (groups.filter(share <= 1 / FINE).withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)))
              .groupBy("cell").applyInPandas(pack, "group string, shard int"))
    placed = spark.createDataFrame(large[["group", "piece", "shard"]].astype({"piece": "int32", "shard": "int32"}),
                                   "group string, piece int, shard int")
    # the large groups go to their rows by broadcast (bounded above), the others by their key, none of which is hot
    by_broadcast = rows.join(F.broadcast(placed), ["group", "piece"])
    by_key = rows.join(F.broadcast(placed.select("group").distinct()), "group", "left_anti").join(packed, "group")
    columns = ["doc_id", "bytes", "tokens", "text_crc32", "group", "shard"]
    return with_slots(by_broadcast.select(columns).unionByName(by_key.select(columns)), int(totals["rows"] or 0), scratch)


def with_slots(rows: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Adds ``slot``: the position within the shard, gapless from 0, by cells that are counted first."""
    cells = max(1, -(-total // SLOT_ROWS))
    dealt = scratch.save(rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "group"), F.lit(cells)).cast("int")), "dealt")
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = "sum(n) over (partition by shard order by cell rows between unbounded preceding and 1 preceding)"
    first = counts.select("shard", "cell", F.coalesce(F.expr(before), F.lit(0)).alias("first"))
    order = "row_number() over (partition by shard, cell order by doc_id, group) - 1"
    return (dealt.withColumn("slot", F.expr(order)).join(first, ["shard", "cell"])
            .withColumn("slot", (F.col("first") + F.col("slot")).cast("long")).drop("first", "cell"))
