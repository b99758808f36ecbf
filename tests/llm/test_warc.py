import base64
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lantern.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reader(piece):
    bodies = [b"", b"x", b"\r\n\r\n" * 5, bytes(range(256)) * 700]
    data = b"".join(warc.member(warc.record_bytes(f"urn:{i}", "http://a/\r\nX: y", b)) for i, b in enumerate(bodies))
    data += warc.member(warc.record_bytes("urn:r", None, bodies[3], "urn:3"))
    got = list(warc.read_records(io.BytesIO(data), piece))
    assert [r.payload for r in got[:4]] == bodies and all(r.verified for r in got)
    assert [r.payload_digest for r in got[:4]] == [digest(b) for b in bodies]
    assert got[4].kind == "revisit" and got[4].payload == b"" and got[4].payload_length == len(bodies[3]) and got[4].payload_digest == digest(bodies[3])
    assert "x" not in got[0].headers and list(warc.read_records(io.BytesIO(b""))) == []


def test_reader_refuses():
    good = warc.record_bytes("urn:1", "http://a", b"hello world")
    for bad in (good.replace(b"hello", b"jello"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"no record\r\n\r\n", good[:-2]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(warc.member(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.member(good)[:-9])))


@pytest.mark.parametrize("least", [0, 4])
def test_pages(spark, least):
    rows = [(5, "u", "same"), (3, "u", "same"), (9, "u", "same"), (None, "u", "same"), (1, None, None), (2, "u", ""), (7, "ü\n", "é" * 700000), (8, "u", "abc"), (4, "u", "abc"), (3, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_pages(pages, least_bytes=least, archive_bytes=200).drop("url").collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        ids = [x for x, _, g in rows if (g or "") == (h or "") and x is not None]
        first = min(ids, default=None) if len(b) >= least else i
        again = first is not None and i != first
        want.append((i, len(b), digest(b), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_several_tasks_read_and_a_task_may_run_twice(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(300)], "page_id long, url string, html string").repartition(3)
    records = warc.with_revisits(pages, "page_id", "url", "html")
    one, two = (warc.write_archives(records, archive_bytes=4000) for _ in range(2))
    paths = [{r.path for r in x.collect()} for x in (one, two)]
    assert len(paths[0]) > 12 and not paths[0] & paths[1]
    for archives in (one, two):
        got = warc.read_archives(archives).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.page_id for r in got) == list(range(300)) and len({r.task for r in got}) > 1
