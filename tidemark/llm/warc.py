"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, then a skippable frame with the seek table
(compressed and decompressed size of each frame; footer with their number and the magic number). An index maps a record's
identifier to its bundle, its frame and its offset in the decompressed frame, so one record is read by decompressing one frame.
Bundles lie in a folder that driver and executors share: any that pyarrow's file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, tidy

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
DATE = "2020-01-01T00:00:00Z"
INDEX = [("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())]
RECORD = "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(urn: str, url: str, payload: bytes, payload_digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record whose payload equals its own."""
    block = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Target-URI: {_header(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    data = bytes(data) if isinstance(data, memoryview) else data
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in rest)}
    start = end + 4
    stop = start + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, data[start:stop], stop + 4


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compress = frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int]] = []
        self.out, self.pending, self.size, self.written = [], [], 0, 0
        self.index: list[tuple[str | None, int, int]] = []

    def add(self, record_id: str | None, data: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size))
        self.pending.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            packed = self.compress(b"".join(self.pending))
            self.frames.append((len(packed), self.size))
            self.out.append(packed)
            self.written += len(packed)
            self.pending, self.size = [], 0

    def close(self) -> bytes:
        self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        return b"".join([*self.out, struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Reads single records of a bundle: its footer first, then only frames that are asked for, the last one is kept."""

    def __init__(self, file):
        self.file, self.last = file, (-1, b"")
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != _SEEKABLE or flags & 0x80:
            raise ValueError("no seek table")
        table_ = self._read(size - 17 - 8 * n, 8 * n + 8)
        if struct.unpack_from("<II", table_) != (_SKIPPABLE, 8 * n + 9):
            raise ValueError("a broken seek table")
        self.frames, start = [], 0
        for i in range(n):
            packed, length = struct.unpack_from("<II", table_, 8 + 8 * i)
            self.frames.append((start, packed, length))
            start += packed

    def _read(self, at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError("no seek table")
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            start, packed, length = self.frames[number]
            self.last = number, zstandard.ZstdDecompressor().decompress(self._read(start, packed), max_output_size=length)
        return self.last[1]

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        """Headers and block of the record at its place in the index."""
        return parse(self.frame(frame), offset)[:2]


@lru_cache(maxsize=8)
def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A folder's file system and its path there."""
    scheme, colon, rest = folder.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{dict(s3a='s3', s3n='s3').get(scheme, scheme)}://{rest}" if colon else folder)


def _urn(record_id: str | None) -> str:
    return f"<urn:tidemark:{record_id}>"


def roles(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """id, sha, first: the revisits, each with the smallest id that has its payload. Hot payloads aggregate before the
    shuffle, and the join back moves ids and digests only, whose large partitions Spark can split."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keys = rows.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    first = keys.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL")
    # equal pairs are alike, so one of them is enough
    return keys.join(first, "sha").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "sha", "first").dropDuplicates(["id", "sha"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes all rows' records to bundles <folder>/*.warc.zst; returns their index, kept in <folder> too: record_id,
    bundle (a file name), frame, offset.

    Of equal payloads of at least `least` bytes the row with the smallest id is the response; rows that repeat it, id
    and payload alike, are responses too. Null payloads are empty, null urls blank; a row without an id revisits any
    row with an id and its payload, and its own record has a random identifier. An empty table gives no bundles; other
    columns are ignored. A task that runs again writes bundles under new names, and the index holds only those of tasks
    whose output was committed.
    """
    revisits = roles(pages, id_col, payload_col, least).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "first")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    joined = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        files, base = _place(folder)
        files.create_dir(base, recursive=True)

        def done() -> pa.RecordBatch:
            name = f"{task:06d}-{uuid.uuid4().hex}.warc.zst"
            content = writer.close()
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:  # the bundle is compressed already
                out.write(content)
            ids, frames, offsets = zip(*writer.index, strict=True)
            return pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip((ids, [name] * len(ids), frames, offsets), INDEX, strict=True)], names=[k for k, _ in INDEX])

        writer = BundleWriter(frame_bytes)
        for batch in batches:
            for i, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = None if i is None else str(i)
                writer.add(name, record(f"<urn:uuid:{uuid.uuid4()}>" if name is None else _urn(name), url, payload, digest(payload), "response" if first is None else "revisit", first))
                if writer.written >= bundle_bytes:
                    yield done()
                    writer = BundleWriter(frame_bytes)
        if writer.index:
            yield done()
        tidy()

    index = joined.mapInArrow(run, "record_id string, bundle string, frame int, offset int")
    path = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(index.schema).parquet(path)


def read_records(index: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """Per row of the index: record_id, payload_bytes, payload_digest, record_type, refers_to, block (null unless blocks).

    Each record is read at its place: the bundle's seek table gives its frame, the index its offset in it. It must be the
    one that the index names, and a response's block must have the digest and length in its header. The index's rows lie
    in the order of the bundles, so a task opens few bundles and each frame once; any other order is right too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        name = reader = None
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
        for batch in batches:
            out, held = [], 0
            for record_id, bundle, frame, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, reader = bundle, BundleReader(files.open_input_file(f"{base}/{bundle}"))
                head, block = reader.record(frame, offset)
                kind, sha, n = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                if record_id is not None and head["warc-record-id"] != _urn(record_id):
                    raise ValueError(f"the index has {record_id} where {head['warc-record-id']} is")
                if kind == "response" and (digest(block) != sha or len(block) != n):
                    raise ValueError(f"record {head['warc-record-id']} does not match its digest")
                to = head.get("warc-refers-to")
                out.append((record_id, n, sha, kind, to and to.removeprefix("<urn:tidemark:").removesuffix(">"), block if blocks else None))
                held += len(block) if blocks else 0
                if held > BUNDLE_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        tidy()

    return index.select("record_id", "bundle", "frame", "offset").mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_records(write_archives(pages, folder), folder, blocks=False)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
