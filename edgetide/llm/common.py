"""What the operators of this subpackage share: words, text keys, fresh column names and the stage table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.scratch import Scratch

# A word, as the result contracts define it: a run of characters that are not ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """Equal for equal texts only (SHA-256); null texts share a key that no text has."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def content_key(text: Column) -> Column:
    """16 bytes that are equal for equal texts (half of a SHA-256); null texts share a key that no text has."""
    return F.coalesce(F.unhex(F.substr(F.sha2(text.cast("binary"), 256), F.lit(1), F.lit(32))), F.lit(b"").cast("binary"))


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """Hints a broadcast if a count of the (saved) DataFrame allows it; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def window_hashes(hashes: Column, size: int) -> Column:
    """A 64-bit hash for every run of ``size`` neighbours in an array of word hashes, by start position."""
    return F.when(F.size(hashes) >= size, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


__all__ = ["WORD", "Scratch", "broadcast_below", "content_key", "fresh", "table", "text_key", "window_hashes", "word_count", "words"]
