"""Schemas of the graph tables and files, and the helpers that keep the caller's timestamp type."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERSON = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

EDGES = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("edge_type", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

# The partition column of an edge table that is also cut by day.
DAY = "sent_day"

TWO_HOP = T.StructType([
    T.StructField("n1", T.LongType()),
    T.StructField("t1", T.TimestampType()),
    T.StructField("n2", T.LongType()),
    T.StructField("t2", T.TimestampType()),
    T.StructField("n3", T.LongType()),
])

REJECTS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

NODE_JSON = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("static_props", T.StructType([T.StructField("email", T.StringType())])),
    T.StructField("is_active", T.BooleanType()),
])

EDGE_JSON = T.StructType([
    T.StructField("edge_id", T.StringType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("edge_type", T.StringType()),
    T.StructField("static_props", T.StructType([T.StructField("timestamp", T.StringType())])),
])


def time_type(df: DataFrame, column: str) -> T.DataType:
    """The column's type, which must be one of the two timestamp types."""
    dtype = df.schema[column].dataType
    if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{column} must be a timestamp, not {dtype.simpleString()}")
    return dtype


def time_literal(value: str | datetime, dtype: T.DataType) -> Column:
    """A literal of the edge table's own timestamp type (an ISO ``T`` or final ``Z`` is accepted)."""
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value.strip().rstrip("Z").replace("T", " ")
    return F.lit(text).cast(dtype)


def plus_hours(moment: Column, hours: int) -> Column:
    return moment + F.make_dt_interval(hours=F.lit(hours))


def plus_seconds(moment: Column, seconds: int) -> Column:
    return moment + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def micros(moment: Column) -> Column:
    """Microseconds since 1970; the cast lets timestamps without a zone through (session zone UTC)."""
    return F.unix_micros(moment.cast("timestamp"))


def millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def from_millis(value: Column, dtype: T.DataType) -> Column:
    return F.timestamp_millis(value).cast(dtype)


def from_micros(value: int, dtype: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(value).cast("long")).cast(dtype)
