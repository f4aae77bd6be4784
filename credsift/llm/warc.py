"""WARC archives: records written, read back and put together as transactions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsift.session import materialise, shared_folder

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive that has grown to so many bytes is closed and another begun.
ARCHIVE_BYTES = 1 << 30
#: Bytes of records that a reader hands over at a time.
BATCH_BYTES = 1 << 22
RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, http_head string, payload binary, block binary"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_text(value: str) -> str:
    """A value for a header line: line ends and other control characters as %XX."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(kind: str, record_id: str, date: str, content_type: str, block: bytes, **more: str | None) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in more.items() if value is not None]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def capture(
    name: str, url: str | None, payload: bytes, size: int, digest: bytes, refers_to: str | None, date: str
) -> tuple[bytes, bytes, bytes]:
    """The response or revisit, request and metadata records of one capture."""
    uri = None if url is None else header_text(url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    about = {"WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha1:{base32_sha1(digest)}"}
    answer_id = f"{name}:response"
    if refers_to is None:
        answer = record("response", answer_id, date, "application/http; msgtype=response", head + payload, **about)
    else:
        answer = record(
            "revisit", answer_id, date, "application/http; msgtype=response", head, **about,
            WARC_Profile=PROFILE, WARC_Refers_To=f"<{refers_to}:response>",
        )
    host, _, path = (uri or "").partition("://")[2].partition("/")
    asked = f"GET /{path.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    with_answer = {"WARC_Target_URI": uri, "WARC_Concurrent_To": f"<{answer_id}>"}
    request = record("request", f"{name}:request", date, "application/http; msgtype=request", asked, **with_answer)
    fields = f"payload-bytes: {size}\r\n".encode()
    metadata = record("metadata", f"{name}:metadata", date, "application/warc-fields", fields, **with_answer)
    return answer, request, metadata


class Archive:
    """Files of gzip members, one per record, named anew for every attempt of a task."""

    def __init__(self, folder: str, series: str, level: int) -> None:
        self.folder, self.series, self.level = folder, series, level
        self.files: list[tuple[str, str, int, int]] = []
        self.out, self.path, self.records, self.size = None, "", 0, 0

    def write(self, raw: bytes) -> None:
        if self.out is None:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            self.path = f"{self.folder}/{self.series}-{part:06d}-{uuid4().hex}.warc.gz"
            system, path = fs.FileSystem.from_uri(self.path)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.records, self.size = system.open_output_stream(path, compression=None), 0, 0
            info = record("warcinfo", f"urn:uuid:{uuid4()}", "2000-01-01T00:00:00Z", "application/warc-fields", b"format: WARC File Format 1.1\r\n")
            self._member(info)
        self._member(raw)
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _member(self, raw: bytes) -> None:
        deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = deflate.compress(raw) + deflate.flush()
        self.out.write(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((self.series, self.path, self.records, self.size))
            self.out = None


def write_archives(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3,
    key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Writes a request, a response or revisit, and a metadata record per row; returns the manifest.

    Of the rows with equal payloads of at least ``min_bytes`` bytes that with
    the smallest key is the response; the others are revisits of it, without
    payload.  Requests and metadata go to files of their own.  The manifest
    (series, path, records, bytes) is a table that Spark commits: files of
    failed or repeated attempts are in no manifest.  ``folder`` is one that all
    executors reach, by default below spark.checkpoint.dir.

    A null payload is empty; a null url has no target.  Record ids hold the
    key; rows that repeat a key, or have none, get a number besides.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives-{uuid4().hex}"
    rows = pages.select(
        F.col(key).cast("string").alias("key"), F.col(key).alias("id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    )
    digested = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    narrow = materialise(digested.select("id", "key", "digest", "size"))
    twins = materialise(
        narrow.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first != last").select("digest", "size", "first")
    )
    again = materialise(narrow.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("again")))
    marked = (
        digested.join(twins, ["digest", "size"], "left").join(again, "key", "left")
        .withColumn("revisit", F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
        .withColumn("number", F.when(F.coalesce("again", F.col("key").isNull()), F.monotonically_increasing_id() + 1).otherwise(0))
        .select(
            F.concat_ws(":", F.lit("urn:page"), F.coalesce("key", F.lit("")), "number").alias("name"), "url", "digest", F.col("size").cast("long"),
            F.when(F.col("revisit"), F.concat_ws(":", F.lit("urn:page"), F.col("first").cast("string"), F.lit("0"))).alias("refers_to"),
            F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, others = Archive(folder, "answers", level), Archive(folder, "others", level)
        for batch in batches:
            for i in range(len(batch)):
                name, uri, digest, size, refers_to, payload = (batch.column(c)[i].as_py() for c in range(6))
                answer, request, metadata = capture(name, uri, payload or b"", size, digest, refers_to, date)
                answers.write(answer)
                others.write(request)
                others.write(metadata)
        answers.close()
        others.close()
        files = answers.files + others.files
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
            ["series", "path", "records", "bytes"],
        )

    return materialise(marked.mapInArrow(run, "series string, path string, records long, bytes long"))


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive that has been unpacked."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record starts with {line[:40]!r}")
            continue
        headers = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def parsed(headers: dict[str, str], block: bytes) -> tuple:
    """A row of RECORDS.  The payload of a response must have the digest that its header states."""
    kind = headers.get("warc-type")
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size, head, payload = None, None, None
    if kind in ("response", "revisit"):
        top, _, body = block.partition(b"\r\n\r\n")
        head = top.decode("latin-1")
        if kind == "response":
            payload, size = body, len(body)
            found = base32_sha1(hashlib.sha1(body).digest())
            if digest is not None and found != digest:
                raise ValueError(f"payload of {headers.get('warc-record-id')} is not what its digest says")
            digest, block = found, None
        else:
            size = next((int(x.split(":")[1]) for x in head.split("\r\n") if x.lower().startswith("content-length:")), None)
    return (
        bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), headers.get("warc-target-uri"),
        headers.get("warc-date"), digest, size, head, payload, block,
    )


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records (RECORDS) of the archives at ``path``, one task per archive, read as a stream."""
    schema = pa.schema([
        (name, {"long": pa.int64(), "binary": pa.binary()}.get(kind, pa.string()))
        for name, kind in (field.split() for field in RECORDS.split(", "))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 17) if uri.endswith(".gz") else io.BufferedReader(raw)
                    for headers, block in records_of(stream):
                        if headers.get("warc-type") == "warcinfo":
                            continue
                        rows.append(parsed(headers, block))
                        size += len(block)
                        if size >= BATCH_BYTES or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = manifest.count()
    return manifest.select("path").repartition(max(1, n)).mapInArrow(run, RECORDS)


def transactions(answers: DataFrame, others: DataFrame) -> DataFrame:
    """One nested row per response or revisit: (page, response, request, metadata).

    Requests and metadata find their response by WARC-Concurrent-To; a missing
    one is null.  Records of other types, or that belong to no response, are
    left out.  The joins are by shuffle: what a reader gives looks as small to
    Spark as the list of archives, and must not be broadcast for that.
    """
    fields = [field.split()[0] for field in RECORDS.split(", ")]
    nested = lambda kind: others.where(F.col("type") == kind).select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "date", "block").alias(kind)
    ).hint("merge")
    page = lambda name: F.split(name, ":")[2]
    return (
        answers.where(F.col("type").isin("response", "revisit"))
        .select("record_id", F.struct(*fields).alias("response"))
        .join(nested("request"), "record_id", "left").join(nested("metadata"), "record_id", "left")
        .select(
            page("record_id").alias("page"), "response", "request", "metadata",
            page("response.refers_to").alias("refers_to_page"),
        )
    )
