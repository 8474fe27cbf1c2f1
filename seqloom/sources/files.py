"""Catalogue snapshots, single records of large files, bitmaps and file inventories."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import ship_package


def catalogue_csv(spark: SparkSession, path: str, header: list[str], sentinel: str | None = None) -> DataFrame:
    """Rows of a CSV snapshot whose header must equal the given one; all columns are text.

    A sentinel, if given, is the first field of the last row and is dropped. Quoted
    fields may hold line ends. A row of another width fails the read.
    """
    schema = ", ".join(f"`{h}` string" for h in header)
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    return rows if sentinel is None else rows.filter(F.col(f"`{header[0]}`").isNull() | (F.col(f"`{header[0]}`") != sentinel))


def selected_line(spark: SparkSession, path: str, line_number: int) -> DataFrame:
    """(file, line, offset, bytes, sha256, text) of one line of each file, with where it begins.

    Byte offsets need the raw file, so each is one task's work.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, k = 0, 1
                while k < line_number and at < len(raw):
                    end = raw.find(b"\n", at)
                    at, k = (len(raw) if end < 0 else end + 1), k + 1
                if k == line_number and at < len(raw):
                    end = raw.find(b"\n", at)
                    line = raw[at : len(raw) if end < 0 else end]
                    out.append((name.rsplit("/", 1)[-1], line_number, at, len(line), hashlib.sha256(line).hexdigest(), line.decode()))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "line", "offset", "bytes", "sha256", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line bigint, offset bigint, bytes bigint, sha256 string, text string")


def bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, content) of raw P4 bitmaps; a header or length that isn't canonical is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pbm").load(path)
    head = F.split(F.decode(F.substring("content", 1, 32), "ISO-8859-1"), "\n")
    size = F.split(F.get(head, 1), " ")
    width, height = F.get(size, 0).try_cast("int"), F.get(size, 1).try_cast("int")
    prefix = F.concat(F.lit("P4\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n"))
    rows = files.select(F.col("_metadata.file_name").alias("file"), width.alias("width"), height.alias("height"), F.length(prefix).alias("skip"), F.decode(F.substring("content", 1, 32), "ISO-8859-1").startswith(prefix).alias("headed"), "content")
    sound = F.coalesce(F.col("headed"), F.lit(False)) & (F.length("content") - F.col("skip") == F.floor((F.col("width") + 7) / 8) * F.col("height"))
    kept = rows.filter(F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("not a canonical bitmap: "), "file")).cast("boolean")))
    return kept.select("file", "width", "height", F.expr("substring(content, skip + 1)").alias("content"))


def _inspect(name: str, raw: bytes) -> tuple[str, bool, int, int]:
    """(format, parses, rows, ragged rows) of a file's bytes."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        text = raw.decode()
        if kind in ("jsonl", "ndjson"):
            rows = [json.loads(line) for line in text.split("\n") if line.strip()]
            return "jsonl", True, len(rows), 0
        if kind == "json":
            value = json.loads(text)
            return "json", True, len(value) if isinstance(value, list) else 1, 0
        if kind in ("csv", "tsv"):
            rows = list(csv.reader(io.StringIO(text), delimiter="\t" if kind == "tsv" else ",", strict=True))
            return kind, True, max(0, len(rows) - 1), sum(len(r) != len(rows[0]) for r in rows)
        return "text" if kind in ("txt", "md") else "other", True, text.count("\n"), 0
    except (UnicodeDecodeError, ValueError, csv.Error):
        return kind if kind in ("jsonl", "json", "csv", "tsv") else "binary", False, 0, 0


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, content_sha256, format, parses, rows, ragged) of every file of a tree."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, raws = batch.column("path").to_pylist(), batch.column("content").to_pylist()
            found = [_inspect(n.rsplit("/", 1)[-1], r) for n, r in zip(names, raws, strict=True)]
            columns = [pa.array(names), pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws])]
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], names=["file", "bytes", "content_sha256", "format", "parses", "rows", "ragged"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, bytes bigint, content_sha256 string, format string, parses boolean, rows bigint, ragged bigint")
