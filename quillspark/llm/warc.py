"""Operator 3, WARC in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently. A bundle ends with two skippable frames: an index, which maps
record ids to frame, offset in the frame and length, and the seek table of the public seekable format, so that a reader gets from
the end of the file to any record by decompressing one frame. Records with equal payloads of ``dedup_bytes`` or more: that with
the smallest id is written whole, the others as revisits of it. The first of each payload is found by an aggregation over digests
and brought to the pages by a join, whose hot keys Spark splits; only digests that occur more than once take part.

Nulls and edge cases: a null html is an empty payload; a null url leaves out the target; a page without an id is always a
response and never the one that is referred to; rows that repeat an id and payload are all responses if no smaller id has
that payload; control characters and blanks in urls are percent-coded; long pages are stored whole, a frame then grows. An empty table gives no
file and an empty result. Page ids are integers. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_file
from .workspace import Workspace

DEDUP_BYTES = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20

# Fixed values of the seekable Zstandard format and of WARC 1.1.
_SKIPPABLE = 0x184D2A50
_SEEK_TABLE = 0x184D2A5E
_SEEK_MAGIC = 0x8F92EAB1
_SEEK_FOOTER = struct.Struct("<IBI")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages have no date


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _lines(pairs: list[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs).encode() + b"\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha256:{digest}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of ``refers_to``, which has the headers of the page alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    head: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return b"WARC/1.1\r\n" + _lines([*head, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Type"] == "warcinfo":
        return Record(headers, {}, block)
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, _headers(http), payload)


class Bundle:
    """Writes a bundle: ``add`` records, then ``tobytes``."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.at = self.size = 0
        info = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
        self.add("<urn:warcinfo>", b"WARC/1.1\r\n" + _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:warcinfo>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")

    def add(self, name: str, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in it and length."""
        place = (len(self.frames), self.at, len(record))
        self.index.append((name, *place))
        self.open.append(record)
        self.at += len(record)
        self.size += len(record)
        if self.at >= self.frame_bytes:
            self._close()
        return place

    def _close(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append((self.compressor.compress(raw), len(raw)))
            self.open, self.at = [], 0

    def tobytes(self) -> bytes:
        self._close()
        index = zlib.compress(json.dumps(self.index, separators=(",", ":")).encode(), 1)
        entries = b"".join(struct.pack("<II", len(f), n) for f, n in self.frames)
        footer = _SEEK_FOOTER.pack(len(self.frames), 0, _SEEK_MAGIC)
        skippable = lambda magic, data: struct.pack("<II", magic, len(data)) + data
        return b"".join(f for f, _ in self.frames) + skippable(_SKIPPABLE, index) + skippable(_SEEK_TABLE, entries + footer)


class Reader:
    """Reads a bundle from its end: ``record`` gets one by its id, ``records`` all, each frame decompressed once."""

    def __init__(self, data: bytes):
        n, descriptor, magic = _SEEK_FOOTER.unpack_from(data, len(data) - _SEEK_FOOTER.size)
        if magic != _SEEK_MAGIC or descriptor & 0x80:
            raise ValueError("no seek table")
        start = len(data) - _SEEK_FOOTER.size - 8 * n
        self.data, self.frames, at = data, [], 0
        for compressed, size in struct.iter_unpack("<II", data[start : start + 8 * n]):
            self.frames.append((at, compressed, size))
            at += compressed
        magic, size = struct.unpack_from("<II", data, at)
        if magic != _SKIPPABLE:
            raise ValueError("no index of records")
        self.index = [tuple(x) for x in json.loads(zlib.decompress(data[at + 8 : at + 8 + size]))]
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, compressed, size = self.frames[i]
        return self.decompressor.decompress(self.data[at : at + compressed], max_output_size=size)

    def record(self, name: str) -> Record:
        _, frame, at, n = next(x for x in self.index if x[0] == name)
        return parse_record(self.frame(frame)[at : at + n])

    def records(self) -> Iterator[Record]:
        last, raw = -1, b""
        for _, frame, at, n in self.index:
            if frame != last:
                last, raw = frame, self.frame(frame)
            yield parse_record(raw[at : at + n])


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, dedup_bytes: int) -> DataFrame:
    """page_id, url, payload, digest and refers_to, null for responses."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    firsts = base.where((F.octet_length("payload") >= dedup_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return base.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = DEDUP_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles as the result is read: a row a record with its file, frame, offset in the frame and length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, bundle, rows = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal number, bundle
            name = f"{part:06d}-{number:06d}.warc.zst"
            write_file(folder, name, bundle.tobytes())
            out = pa.RecordBatch.from_pydict({"page_id": pa.array([r[0] for r in rows], pa.int64()), "file": pa.array([name] * len(rows)), "frame": pa.array([r[1] for r in rows], pa.int64()), "offset": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64())})
            number, bundle = number + 1, None
            rows.clear()
            return out

        for batch in batches:
            for i in range(0, len(batch), 64):
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    bundle = bundle or Bundle(frame_bytes)
                    rows.append((page_id, *bundle.add(record_id(page_id, digest), make_record(page_id, url, payload, digest, refers_to))))
                    if bundle.size >= bundle_bytes:
                        yield close()
        if bundle:
            yield close()

    ordered = decided(pages, id_col, url_col, html_col, dedup_bytes).sortWithinPartitions("page_id", "digest", "url")  # a task that runs again writes the same files
    return ordered.mapInArrow(write, "page_id long, file string, frame long, offset long, length long")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row a page record, from the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the payload read and must be that of its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    page = re.compile(r"<urn:page:(-?\d+)>")

    def number(value: str) -> int | None:
        found = page.fullmatch(value)
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for r in Reader(data.as_py()).records():
                    kind = r.headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(r.payload).hexdigest() != digest or len(r.payload) != int(r.http["Content-Length"])):
                        raise ValueError(f"the payload of {r.headers['WARC-Record-ID']} is damaged")
                    rows.append((number(r.headers["WARC-Record-ID"]), int(r.http["Content-Length"]), digest, kind, number(r.headers["WARC-Refers-To"]) if kind == "revisit" else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes the bundles, with their index as a table beside them, and reads all records back."""
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    ws.save(write_warc(pages, ws.path("bundles"), **how), "index")
    return read_warc(spark, ws.path("bundles"))
