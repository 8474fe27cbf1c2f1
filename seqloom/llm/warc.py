"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. Behind them stand two
skippable frames, which any decoder passes over: an index that maps record
identifiers to frame, offset within the frame and length, and the seek table of
the seekable format, which gives every frame's compressed and plain size. A
reader finds a record by decompressing one frame.

Bundles are rows (bundle, content) of a table, so that Spark's own writer
commits them: an executor may be lost at any time, and the store may be one that
only Spark reaches. export() writes them as files.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches, text_or_empty
from seqloom.runtime import Scratch, attach, ship_package

#: Plain bytes in a frame and compressed bytes in a bundle after which the next begins; a record is never cut.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 4 << 20
#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
DATE = "2000-01-01T00:00:00Z"
IDS = uuid.UUID("6f1d8f0e-5c0a-5a53-9a53-2f6f0f1b7a11")
# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX_SKIPPABLE = 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(IDS, str(row))}>"


def record(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first_row: int | None, first_page: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (first_row is another row) carries the HTTP head alone."""
    revisit = first_row is not None and first_row != row
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_row)}", f"X-Refers-To-Page: {'' if first_page is None else first_page}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames and gives the finished bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.plain, self.held, self.size = [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append((name.encode(), len(self.frames), self.held, len(data)))
        self.plain.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.plain:
            packed = self.compressor.compress(b"".join(self.plain))
            self.frames.append((packed, self.held))
            self.size += len(packed)
            self.plain, self.held = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        index = self.compressor.compress(b"".join(struct.pack("<HIQQ", len(n), f, o, s) + n for n, f, o, s in self.index))
        table = b"".join(struct.pack("<II", len(p), s) for p, s in self.frames)
        table += struct.pack("<II", 8 + len(index), 0)  # the index frame has no plain bytes
        footer = struct.pack("<IBI", len(self.frames) + 1, 0, SEEK_MAGIC)
        return b"".join(p for p, _ in self.frames) + struct.pack("<II", INDEX_SKIPPABLE, len(index)) + index + struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer


class Bundle:
    """Reads a bundle through its footer."""

    def __init__(self, content):
        self.content = memoryview(content)
        count, flags, magic = struct.unpack("<IBI", self.content[-9:])
        if magic != SEEK_MAGIC or flags:
            raise ValueError("not a seekable bundle")
        table = self.content[len(self.content) - 9 - 8 * count : -9]
        self.places, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.places.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.places[k]
        return zstandard.ZstdDecompressor().decompress(self.content[at : at + packed], max_output_size=max(1, plain))

    def frames(self) -> Iterator[bytes]:
        for k in range(len(self.places) - 1):
            yield self.frame(k)

    def index(self) -> dict[str, tuple[int, int, int]]:
        """Frame, offset within it and length of each record."""
        at, packed, _ = self.places[-1]
        data = zstandard.ZstdDecompressor().decompress(self.content[at + 8 : at + packed])
        found, k = {}, 0
        while k < len(data):
            n, frame, offset, size = struct.unpack_from("<HIQQ", data, k)
            found[data[k + 22 : k + 22 + n].decode()] = (frame, offset, size)
            k += 22 + n
        return found

    def fetch(self, name: str) -> bytes:
        """One record; only its frame is decompressed."""
        frame, offset, size = self.index()[name]
        return self.frame(frame)[offset : offset + size]


def headers(data: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in data.decode().split("\r\n")[1:] if ": " in line)


def records(plain: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record, in order."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        head = headers(plain[at:end])
        block = plain[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, headers(http), payload


def write(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Archive pages (page_id, url, html) below path and return the table of bundles.

    Of records with equal payloads of at least LEAST_SHARED bytes the one with
    the smallest page_id is a response (among equal page_ids the first row), the
    others are revisits; a null page_id comes last. Null html is an empty
    payload, a null url an urn of the page.
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "warc")
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    shared = rows.filter(F.col("size") >= LEAST_SHARED)
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    groups = scratch.keep(shared.groupBy("digest").agg(best.alias("first"), F.count("*").alias("uses")), "groups")
    total = groups.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    # Only payloads that occur again need to know of each other.
    again = groups.filter("uses > 1").select("digest", "uses", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page"))
    again = scratch.keep(again, "again")
    narrow = shared.select("row", "digest")
    revisits = attach(narrow, again, "digest", "uses", total).filter("row <> first_row").select("row", "first_row", "first_page")
    revisits = scratch.keep(revisits, "revisits")
    whole = rows.join(revisits, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def bundle() -> pa.RecordBatch:
            name = f"part-{part:06d}-{turn:06d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.finish()], pa.binary())], names=["bundle", "content"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("row", "page_id", "url", "html", "digest", "first_row", "first_page")), strict=True):
                row, page_id, url, text, digest, first_row, first_page = r
                writer.add(record_id(row), record(row, page_id, url, text.encode(), digest, first_row, first_page))
                if writer.size >= bundle_bytes:
                    yield bundle()
                    writer, turn = BundleWriter(frame_bytes), turn + 1
        if writer.index:
            yield bundle()

    bundles = whole.mapInArrow(run, "bundle string, content binary")
    bundles.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    scratch.drop(rows)
    return spark.read.schema("bundle string, content binary").parquet(path)


def read(bundles: DataFrame) -> DataFrame:
    """One row per archived record: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload, and a digest that
    differs from the header is an error; a revisit has them in its headers.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6)]
            for k in range(batch.num_rows):
                for plain in Bundle(batch.column("content")[k].as_buffer()).frames():
                    for head, http, payload in records(plain):
                        revisit = head["WARC-Type"] == "revisit"
                        stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                        page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                        values = (int(page) if page else None, head["WARC-Target-URI"], int(http["Content-Length"]) if revisit else len(payload), digest, head["WARC-Type"], int(refers) if refers else None)
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        return each

    return map_batches(bundles.select("content"), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", make)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as folder/<bundle>.warc.zst, on a file system all executors share; (bundle, bytes) of what was written.

    A file appears under its name only when it is whole, so a repeated task does no harm.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = []
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}.warc.zst")
                sizes.append(len(content))
            return pa.RecordBatch.from_arrays([batch.column("bundle"), pa.array(sizes, pa.int64())], names=["bundle", "bytes"])

        return each

    return map_batches(bundles, "bundle string, bytes bigint", make)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder and read them back: one row per page.

    page_id, payload_bytes, payload_digest, record_type (response or revisit),
    refers_to (the response's page_id, null for responses). Repeated rows are
    archived each; an empty table gives no rows.
    """
    bundles = write(pages, Scratch(pages.sparkSession, "bundles").path("archive"))
    return read(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
