"""Mail corpora: one text file per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.functions.mail_text import (
    addresses, date_parts, header, header_block, local_and_offset, moment_of, strip, unix_lines)


def read_mail(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every message below ``folder``: files whose name ends in a dot or a digit.

    Bytes that are not UTF-8 are left out; an empty file gives no row.
    """
    files = (
        spark.read.option("pathGlobFilter", "*[0-9.]")
        .text(folder, wholetext=True, recursiveFileLookup=True)
    )
    return files.select(F.col("_metadata.file_path").alias("path"),
                        F.regexp_replace(F.make_valid_utf8("value"), "�", "").alias("content"))


def _once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the new columns, which are computed once per row however often later steps and filters use them.

    Plain projections are merged, and a filter on their result repeats the text functions; a generator is not.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def parse_mail(mail: DataFrame) -> DataFrame:
    """(path, sender, to, cc, bcc, sent_at_iso, sent_at, reason) per message.

    ``reason`` says why a message is rejected and is null for the accepted ones. Copies are read from X-cc and X-bcc.
    The ISO text keeps the date's own offset because edge ids are hashed from it.
    """
    text = _once(mail, ["path"], text=unix_lines(F.col("content")))
    block = _once(text, ["path"], block=header_block(F.col("text")))
    names = {"from_value": "From", "to_value": "To", "cc_value": "X-cc", "bcc_value": "X-bcc", "date_value": "Date"}
    values = _once(block, ["path"], **{c: header(F.col("block"), name) for c, name in names.items()})
    parts = _once(
        values, ["path"],
        sender=F.lower(strip(F.col("from_value"))), to=addresses(F.col("to_value")), cc=addresses(F.col("cc_value")),
        bcc=addresses(F.col("bcc_value")), dated=F.col("date_value").isNotNull(), parts=date_parts(F.col("date_value")))
    local, offset = local_and_offset(F.col("parts"))
    people = ["path", "sender", "to", "cc", "bcc"]
    times = _once(parts, [*people, "dated"], local=local, offset=offset)
    parsed = _once(times, [*people, "dated", "local", "offset"], sent_at=moment_of(F.col("local"), F.col("offset")))
    reason = (
        F.when(F.col("sender").isNull(), "no From")
        .when(F.size("to") == 0, "no To")
        .when(~F.col("dated"), "no Date")
        .when(F.col("sent_at").isNull(), "bad Date")
    )
    iso = F.when(F.col("sent_at").isNotNull(), F.concat("local", "offset"))
    return parsed.select(*people, iso.alias("sent_at_iso"), "sent_at", reason.alias("reason"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NULL").drop("reason")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NOT NULL").select("path", "reason")
