"""WARC archives with a splittable reader (operator 7).

Writing: pages with equal payloads are grouped by digest; the smallest page_id is written as a ``response``, the others
as ``revisit`` records that refer to it. A record is one gzip member. A task writes archives of at most
``ARCHIVE_BYTES`` under names of its own and returns their paths and lengths; that list is saved by Spark, so files of
tasks that failed or ran twice are never read.

Reading: an archive is cut into byte ranges and each range is a row, so one large archive is read by many tasks. A task
looks for the gzip magic in its range and on to the end of a record that starts inside. Magic bytes also occur by
chance within compressed data, so each candidate is tried: it is a record only if it inflates and begins with a WARC
version line and headers of any length whose Content-Length fits. After a record the search goes on behind it; a range owns exactly
the records that start inside, whatever its length. The writer leaves no gaps, so a range also checks that its records
follow each other, and that another one begins where its last one ends: a record that cannot be read raises.

A range may start within a record, where the data can hold by chance a candidate that inflates to a valid WARC header
(a WARC file stored as a payload is compressed again by its member, so its own magic does not show). The odds of that
are nil in practice, and the digest in the header is checked against the payload as well.

Defined results: a null html has an empty payload; a row with a null page_id is always a response; rows that repeat
both page_id and payload of a response are responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MAX_TASKS = 20_000
ARCHIVE_BYTES = 1 << 30
MANIFEST = "path string, length long, records long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, offset long"


def digest_of(payload: bytes) -> str:
    """Base 32 of the SHA-1, as WARC digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no block; the length of its payload is in a header field."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI with the scheme that Spark itself would use for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _open(uri: str):
    """The file system and path of a URI."""
    return fs.FileSystem.from_uri(uri)


def writer(folder: str):
    """Rows (page_id, url, payload, refers_to, digest) -> the manifest of the archives that the task has written."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out, path, length, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, length, records = f"{folder}/{name}", 0, 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = encode(row["page_id"], row["url"], row["payload"], row["refers_to"], row["digest"])
                out.write(member)
                length, records = length + len(member), records + 1
                if length >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, length, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, length, records))
        for path, length, records in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "records": [records]})

    return write


class Window:
    """A file's bytes from a moving start on, read piece by piece."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""
        self.file.seek(start)

    def more(self) -> bool:
        piece = self.file.read(min(READ_BYTES, self.size - self.at - len(self.data)))
        self.data += piece
        return bool(piece)

    def forget(self, offset: int) -> None:
        self.data, self.at = self.data[offset - self.at:], offset


def inflate(window: Window, offset: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at an offset and the offset behind it; None if there is no WARC record there."""
    tool, content, used = zlib.decompressobj(wbits=31), bytearray(), offset - window.at
    while not tool.eof:
        if used >= len(window.data):
            used = len(window.data)
            if not window.more():
                return None
        piece = window.data[used:used + READ_BYTES]
        try:
            content += tool.decompress(piece)
        except zlib.error:
            return None
        used += len(piece) - len(tool.unused_data)
        if not b"WARC/".startswith(bytes(content[:5])):
            return None
    return bytes(content), window.at + used


def parse(content: bytes) -> dict | None:
    """Headers and block of a record; None if they are not those of a whole record."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    if not gap or not version.startswith("WARC/") or not length.isdigit() or len(rest) != int(length) + 4:
        return None
    return fields | {"block": rest[:int(length)]}


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) for every record that starts in [start, end)."""
    window, offset = Window(file, start, size), start
    while offset < end:
        found = window.data.find(MAGIC, offset - window.at)
        if found < 0:
            # the last bytes may be the first of a magic that goes on behind them
            offset = max(offset, window.at + len(window.data) - len(MAGIC) + 1)
            window.forget(min(offset, window.at + len(window.data)))
            if not window.more():
                return
            continue
        offset = window.at + found
        if offset >= end:
            return
        window.forget(offset)
        member = inflate(window, offset)
        record = parse(member[0]) if member else None
        if record is None:
            offset += 1
        else:
            yield offset, record | {"end": member[1]}
            offset = member[1]
            window.forget(offset)


def begins(file, size: int, offset: int) -> bool:
    """Whether a whole record begins at an offset."""
    member = inflate(Window(file, offset, size), offset)
    return member is not None and parse(member[0]) is not None


def _page(text: str | None) -> int | None:
    number = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, length, start, end) -> ``RECORD`` rows; a response whose payload does not fit its digest raises."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("offset", pa.int64())])
    for batch in batches:
        for part in batch.to_pylist():
            system, path = _open(part["path"])
            rows, held, due = [], 0, None if part["start"] else 0
            with system.open_input_file(path) as file:
                for offset, record in records_in(file, part["length"], part["start"], part["end"]):
                    if due is not None and offset != due:
                        raise ValueError(f"{part['path']} at {due}: no record can be read")
                    due = record["end"]
                    digest, block = record["warc-payload-digest"].removeprefix("sha1:"), record["block"]
                    if record["warc-type"] == "response" and digest_of(block) != digest:
                        raise ValueError(f"{part['path']} at {offset}: the payload does not fit its digest")
                    rows.append({
                        "page_id": _page(record["warc-record-id"]), "url": record["warc-target-uri"], "record_type": record["warc-type"],
                        "payload_digest": digest, "payload_bytes": int(record["x-payload-length"]),
                        "refers_to": _page(record.get("warc-refers-to")), "payload": block, "offset": offset})
                    held += len(block)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if due is not None and due < part["length"] and not begins(file, part["length"], due):
                    raise ValueError(f"{part['path']} at {due}: no record can be read")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below a shared folder; the saved manifest."""
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"").cast("binary"))
    named = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    first = named.groupBy("sha1").agg(F.min("page_id").alias("first"))
    linked = named.join(first, "sha1")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = linked.select("page_id", "url", "payload", refers.alias("refers_to"), _base32(F.hex("sha1")).alias("digest"))
    return scratch.save(rows.mapInArrow(writer(folder), MANIFEST), "manifest")


def _base32(hexed):
    """RFC 4648 base 32 of 20 bytes given in hexadecimal digits: 40 bits are ten digits and eight characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(4):
        number = F.conv(F.substr(hexed, F.lit(1 + 10 * k), F.lit(10)), 16, 10).cast("long")
        parts += [F.substr(letters, F.shiftright(number, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``RECORD`` rows of all archives in a manifest (path, length), by byte ranges dealt over the cluster.

    A task reads one range; only beyond ``MAX_TASKS`` ranges it reads several. The number of tasks is given, as adaptive
    execution would put ranges, which are small rows, together in one.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.filter("length > 0").select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.least("length", F.col("start") + range_bytes))
    count = F.ceil(F.col("length") / F.lit(range_bytes))
    tasks = manifest.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    return ranges.repartition(max(1, min(int(tasks), MAX_TASKS))).mapInArrow(read, RECORD)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    scratch = Scratch(spark)
    return read_archives(write_archives(pages, scratch.path("archives"), scratch))
