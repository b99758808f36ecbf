"""WARC archives: a writer and a sequential reader.

An archive is a row of gzip members, one record each. The reader takes a byte stream in small pieces, inflates a member
incrementally, frames the record by its Content-Length and verifies the digests of block and payload, so its memory is
bounded by the piece size and one record.

`archive_pages` writes a record for each page. Pages with equal payloads are one response, that of the smallest page_id,
and revisits, whose block is the HTTP header alone. An archive's name is unique, so a task that runs again or twice at a
time writes archives of its own; only the paths that a successful task returns as rows are read. The archives stand in the
shared folder and are read by about a task each, or by one for several small ones.

Defined results: null html is the empty payload; a null page_id is never the smallest unless all are null, and comes back
null; repeated rows of the smallest page_id are responses each; control characters of a url are percent-encoded and a
null url is `urn:none`; payloads of any length are one record each, which is held in memory whole; an empty table gives no
archives and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, saved, scratch_path

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records that a reading task gets, about, in whole archives.
READ_RECORDS = 4000
PIECE = 1 << 16
LEVEL = 4
#: Date of all records; it is not part of any result.
DATE = "2024-01-01T00:00:00Z"
_PAGE = "urn:lantern:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def sha1(data: bytes) -> str:
    return base32(hashlib.sha1(data).digest())


# --- records ----------------------------------------------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    verified: bool = False

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload_length(self) -> int:
        """Of the full payload; a revisit's is in its HTTP header."""
        return int(self.http.get("content-length", len(self.payload)))

    @property
    def payload_digest(self) -> str:
        return self.headers.get("warc-payload-digest", "").removeprefix("sha1:")


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_bytes(name: str, url: str | None, payload: bytes, refers_to: str | None = None, digest: str | None = None) -> bytes:
    """One record before compression: a response, or a revisit of the record named."""
    block = http_head(len(payload)) + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest or sha1(payload)}", f"WARC-Block-Digest: sha1:{sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def _members(stream: BinaryIO, piece: int) -> Iterator[Iterator[bytes]]:
    """Each gzip member as an iterator of inflated pieces; a member is used up before the next is asked for."""
    rest = stream.read(piece)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while True:
                data = inflate.decompress(rest, piece)
                rest = inflate.unconsumed_tail
                if data:
                    yield data
                if inflate.eof:
                    rest = inflate.unused_data or stream.read(piece)
                    return
                if not rest:
                    rest = stream.read(piece)
                    if not rest:
                        raise ValueError("a gzip member is cut off")

        yield pieces()


def read_records(stream: BinaryIO, piece: int = PIECE) -> Iterator[Record]:
    """Records in order. Raises ValueError where framing or a digest is wrong."""
    for pieces in _members(stream, piece):
        buffer = bytearray()
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            more = next(pieces, None)
            if more is None:
                raise ValueError("a record has no header")
            buffer += more
        head = bytes(buffer[:cut])
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        record = Record(_fields(head))
        del buffer[: cut + 4]
        length = int(record.headers["content-length"])
        while len(buffer) < length + 4 and (more := next(pieces, None)) is not None:
            buffer += more
        if bytes(buffer[length:]) != b"\r\n\r\n" or next(pieces, None):
            raise ValueError("a record's length is not its Content-Length")
        block = bytes(buffer[:length])
        said = record.headers.get("warc-block-digest")
        if said and said != f"sha1:{sha1(block)}":
            raise ValueError("a block's digest is wrong")
        if record.headers.get("content-type", "").startswith("application/http"):
            end = block.find(b"\r\n\r\n")
            record.http, record.payload = _fields(block[:end]), block[end + 4 :]
        else:
            record.payload = block
        said = record.headers.get("warc-payload-digest")
        if said and record.kind != "revisit" and said != f"sha1:{sha1(record.payload)}":
            raise ValueError("a payload's digest is wrong")
        record.verified = True
        yield record


# --- Spark ------------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, html, refers_to (null: a response)."""
    small = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    small = small.withColumn("digest", F.unhex(F.sha1("html")))
    sized = small.filter(F.octet_length("html") >= least_bytes).select("id", "digest")
    groups = sized.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # written before the join, which then deals the pages by itself, so that a frequent payload's can be split
    joined = small.join(saved(groups.select("digest", "first"), "first"), "digest", "left")
    return joined.select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write id, url, html, refers_to as WARC records; path, records of the archives."""
    spark = records.sparkSession
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        made: list[tuple[str, int]] = []
        out, name, size, n = None, "", 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            made.append((f"{folder}/{name}", n))
            out = None

        for batch in batches:
            for key, url, html, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, size, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                refers = to.as_py()
                data = record_bytes(f"{_PAGE}{'' if key.as_py() is None else key.as_py()}", url.as_py(), payload, None if refers is None else f"{_PAGE}{refers}")
                out.write(member(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.int64())], ["path", "records"])

    return saved(records.select("id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def read_archives(paths: DataFrame, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of the records of the archives (path, records)."""
    archives, records = paths.agg(F.count("*"), F.sum("records")).first()
    tasks = max(1, min(archives, max(paths.sparkSession.sparkContext.defaultParallelism, -(-(records or 0) // READ_RECORDS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(urn: str | None) -> str | None:
            return (urn or "").strip("<>").removeprefix(_PAGE) or None

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _filesystem(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        rows.append((page(r.headers.get("warc-record-id")), r.payload_length, r.payload_digest, r.kind, page(r.headers.get("warc-refers-to")), r.headers.get("warc-target-uri")))
                        if len(rows) == 2000:
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    rows = paths.select("path").repartition(tasks).mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")
    return rows.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as WARC archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    prepare(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    archives = write_archives(with_revisits(pages, id_col, url_col, html_col, least_bytes), archive_bytes)
    return read_archives(archives, kind).withColumnRenamed("page_id", id_col)
