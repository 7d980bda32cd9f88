import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from edgetide.llm import warc as w
from edgetide.llm.common import Scratch


def archive(payloads):
    members = [w.encode(i, f"http://x/{i}", x, None, w.digest_of(x)) for i, x in enumerate(payloads)]
    return b"".join(members), [sum(map(len, members[:i])) for i in range(len(members))]


@pytest.mark.parametrize("step", [1, 7, 100, 1000, 10**9])
def test_every_record_is_read_once_whatever_the_ranges(step):
    rng = random.Random(3)
    payloads = [b"", b"a", rng.randbytes(3000), w.MAGIC * 40, gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), b"x" * 5000, rng.randbytes(1)]
    data, starts = archive(payloads)
    got = [(o, r) for a in range(0, len(data), step) for o, r in w.records_in(io.BytesIO(data), len(data), a, min(len(data), a + step))]
    assert [o for o, _ in got] == starts and [r["block"] for _, r in got] == payloads


def test_pieces_smaller_than_a_record(monkeypatch):
    monkeypatch.setattr(w, "READ_BYTES", 5)
    payloads = [random.Random(i).randbytes(200) for i in range(5)]
    data, starts = archive(payloads)
    assert [o for o, _ in w.records_in(io.BytesIO(data), len(data), 0, len(data))] == starts


def test_gzip_that_is_no_record_and_broken_members_are_passed_over():
    good, _ = archive([b"one", b"two"])
    data = gzip.compress(b"not a record") + good + w.MAGIC + b"junk" + good[:20]
    assert [r["block"] for _, r in w.records_in(io.BytesIO(data), len(data), 0, len(data))] == [b"one", b"two"]


def test_members_are_plain_gzip():
    data, _ = archive([b"one"])
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and zlib.decompressobj(31).decompress(data)


def test_revisits_nulls_repeats_and_long_pages(spark):
    long = "é" * 3_000_000
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (None, "u", "same"), (1, "u1", None), (2, "a\r\nb", ""), (7, "u7", long), (3, "u3", "same")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, digest string")
    scratch = Scratch(spark)
    manifest = w.write_archives(pages, scratch.path("archives"), scratch)
    got = w.read_archives(manifest, 500).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(0, "response", None, 4), (1, "response", None, 0), (2, "revisit", 1, 0), (3, "response", None, 4), (3, "response", None, 4),
                     (5, "revisit", 3, 4), (7, "response", None, 6_000_000), (9, "revisit", 3, 4)]
    assert {r.payload_digest for r in got if r.payload_bytes == 4} == {w.digest_of(b"same")}
    assert next(r for r in got if r.page_id == 7).payload.decode() == long
    assert w.archive_and_read(spark, pages.limit(0)).count() == 0


def test_a_damaged_payload_is_noticed(spark, tmp_path):
    member = gzip.decompress(w.encode(1, "u", b"payload", None, w.digest_of(b"payload"))).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(member))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", (tmp_path / "x.warc.gz").stat().st_size)], "path string, length long")
    with pytest.raises(Exception, match="does not fit its digest"):
        w.read_archives(manifest).collect()


@pytest.mark.parametrize("range_bytes", [500, 10**9])
def test_long_urls_are_read_and_missing_records_are_noticed(spark, tmp_path, range_bytes):
    url = "data:text/plain," + random.Random(1).randbytes(150_000).hex()
    rows = [(1, "u1", "one"), (2, url, "two"), (3, url, "two"), (4, "u4", "four")]
    scratch = Scratch(spark)
    manifest = w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch.path("archives"), scratch)
    got = w.read_archives(manifest, range_bytes).collect()
    assert sorted((r.page_id, r.url) for r in got) == [r[:2] for r in rows]
    data, starts = archive([b"one", b"two", b"three"])
    for at in starts:
        path = tmp_path / f"{at}.warc.gz"
        path.write_bytes(data[:at] + b"\0" + data[at + 1:])
        with pytest.raises(Exception, match="no record can be read"):
            w.read_archives(spark.createDataFrame([(f"file://{path}", len(data))], "path string, length long"), range_bytes).collect()


def test_ranges_are_read_by_as_many_tasks(spark):
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"u{i}", rng.randbytes(2000).hex()) for i in range(300)], "page_id long, url string, html string")
    scratch = Scratch(spark)
    manifest = w.write_archives(pages, scratch.path("archives"), scratch).cache()
    range_bytes = 20_000
    ranges = sum(-(-r.length // range_bytes) for r in manifest.collect())
    read = w.read_archives(manifest, range_bytes)
    per_task = read.groupBy(F.spark_partition_id()).count().collect()
    assert read.rdd.getNumPartitions() == ranges > 20 and len(per_task) > ranges // 2
    assert sum(r["count"] for r in per_task) == 300 == sum(r.records for r in manifest.collect())
