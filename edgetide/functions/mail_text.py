"""Column functions for message texts: header values, address lists, dates, edge hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names of mail dates and their offsets from UTC; any other name counts as UTC without an offset.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "AST": "-0400", "ADT": "-0300",
    "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600",
    "PST": "-0800", "PDT": "-0700",
}

# Month names of mail dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

HEADER_LINE = r"(?:From |[!-9;-~]*:|[ \t])"
FOLD = "\u0001"
SPACE = r"[\s\x1c-\x1f]"


def unix_lines(content: Column) -> Column:
    return F.regexp_replace(content, r"\r\n?", "\n")


def header_block(text: Column) -> Column:
    """The leading header lines of a text with ``\\n`` line ends, each folded header on one line (folds are marked).

    The block ends at the first line that cannot be a header line, such as a blank one.
    """
    end = F.regexp_instr(text, F.lit(rf"(?d)\n(?!{HEADER_LINE})"))
    length = F.when(end > 0, end - 1).otherwise(F.length(text))
    block = F.when(text.rlike(rf"\A{HEADER_LINE}"), F.substring(text, F.lit(1), length))
    return F.regexp_replace(F.coalesce(block, F.lit("")), r"\n(?=[ \t])", FOLD)


def header(block: Column, name: str) -> Column:
    """The value of the first header of this name, null when there is none."""
    line = F.nullif(F.regexp_extract(block, rf"(?idm)^{name}:[^\n]*", 0), F.lit(""))
    value = F.ltrim(F.substring(line, F.lit(len(name) + 2), F.length(line)), F.lit(" \t"))
    return F.translate(value, FOLD, "\n")


def strip(text: Column) -> Column:
    """Without white space at both ends; Spark's trim only takes blanks."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def addresses(value: Column) -> Column:
    """A comma-separated address list as lower-case, stripped, non-empty strings; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda a: F.lower(strip(a)))
    return F.filter(parts, lambda a: a != "")


def date_parts(value: Column) -> Column:
    """Day, month name, year, hour, minute, second and zone of a mail date, as an array of texts.

    A text that is no such date gives an array of itself only.
    """
    pattern = (r"(?is)^\s*(?:[a-z]+\s*,?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{4}|\d{2})\s+"
               r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]+)?(?![\w:]).*$")
    return F.split(F.regexp_replace(value, pattern, FOLD.join(f"${i}" for i in range(1, 8))), FOLD)


def local_and_offset(parts: Column) -> tuple[Column, Column]:
    """From the parts of a date: its local time as ISO-8601 text and its offset (``-07:00``).

    The offset is empty for a date without one, with -0000 or with an unknown zone name.
    """
    day, month, year, hour, minute, second, zone = (F.get(parts, i) for i in range(7))
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(month))
    number = year.try_cast("int")
    year = F.when(F.length(year) == 4, number).when(number > 68, number + 1900).otherwise(number + 2000)
    second = F.when(second == "", F.lit("00")).otherwise(second)
    local = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
        F.lpad(day, 2, "0"), F.lit("T"), F.lpad(hour, 2, "0"), F.lit(":"), minute, F.lit(":"), second)
    names = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    zone = F.when(zone.rlike(r"^[+-]\d{4}$"), zone).otherwise(F.element_at(names, F.upper(zone)))
    offset = F.when(zone.isNull() | (zone == "-0000"), F.lit("")).otherwise(
        F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
    return local, offset


def moment_of(local: Column, offset: Column) -> Column:
    """The timestamp of a local time and its offset, null when there is no such time; no offset means UTC."""
    zoned = F.concat(local, F.when(offset == "", F.lit("+00:00")).otherwise(offset))
    return F.try_to_timestamp(zoned, F.lit("yyyy-MM-dd'T'HH:mm:ssxxx"))


def edge_id(src: Column, dst: Column, iso_time: Column, edge_type: Column) -> Column:
    """SHA-256 of the edge as JSON text with its keys in alphabetical order."""
    return F.sha2(F.concat(
        F.lit('{"dst": '), dst.cast("string"), F.lit(', "src": '), src.cast("string"),
        F.lit(', "timestamp": "'), iso_time, F.lit('", "type": "'), edge_type, F.lit('"}')), 256)
