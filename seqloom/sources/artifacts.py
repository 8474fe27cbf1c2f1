"""The nested artifact corpus: its schema, strict JSON Lines in, deterministic JSON Lines out."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.runtime import ship_package

RIGHTS = (
    "struct<status:string,license_id:string,license_uri:string,rights_holder:string,redistribution:boolean,derivatives:boolean,"
    "commercial_use:boolean,statement:string,evidence_uri:string,verified_at:string>"
)
TOKEN = (
    "struct<token_id:string,sign_id:string,visual_index:int,reading_index:int,confidence:double,condition:string,"
    "uncertainty:struct<status:string,alternatives:array<struct<sign_id:string,confidence:double>>,notes:string>,"
    "geometry:struct<image_id:string,coordinate_space:string,polygon:array<struct<x:double,y:double>>>,source_record_ids:array<string>>"
)
LINE = f"struct<line_id:string,visual_order_basis:string,reading_direction:string,direction_confidence:double,tokens:array<{TOKEN}>>"
#: One artifact. extensions stays text, so that any namespaced keys pass through unchanged.
ARTIFACT = (
    "schema_version string, artifact_id string,"
    "source_records array<struct<source_record_id:string,source_id:string,upstream_record_id:string,role:string,locator:string,retrieved_at:string,revision:string,source_path:string,record_hash:string>>,"
    f"rights {RIGHTS}, catalog_crosswalk array<struct<catalog:string,identifier:string,record_uri:string,certainty:double>>,"
    "site struct<site_id:string,name:string,modern_country:string,administrative_area:string,findspot:string,certainty:double>,"
    "period struct<label:string,phase:string,earliest_year_bce:int,latest_year_bce:int,basis:string,certainty:double>,"
    "object struct<object_type:string,material:string,dimensions_mm:struct<width:double,height:double,depth:double>,condition:string,"
    "collection:struct<institution:string,accession_number:string>,observed_motifs:array<string>>,"
    "duplicate_family_id string,"
    f"images array<struct<image_id:string,source_id:string,image_role:string,uri:string,iiif_manifest:string,image_hash:string,pixel_width:int,pixel_height:int,rights:{RIGHTS}>>,"
    f"sides array<struct<side_id:string,physical_form:string,image_ids:array<string>,lines:array<{LINE}>>>,"
    "observation_notes string, extensions string"
)


class StrictJsonError(ValueError):
    """JSON that has a key twice, a number that isn't finite, or isn't JSON."""


@dataclass(frozen=True)
class JsonLimits:
    """Most bytes in UTF-8, most levels below the root, and most values of all kinds, the root included."""

    size: int = 1 << 26
    depth: int = 256
    values: int = 1 << 20


#: A string that is not closed runs to the end, so that no character is looked at twice.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.S)
_SIGN = re.compile(r"[\[{]\s*+[\]}]|[\[{\]},]")


def check_limits(text: str, limits: JsonLimits) -> None:
    """Fail on JSON beyond the limits before any of it is parsed: brackets and commas outside strings tell levels and values."""
    if len(text) > limits.size or len(text.encode("utf-8", "surrogatepass")) > limits.size:
        raise StrictJsonError(f"more than {limits.size} bytes")
    level, values = 0, 1
    for sign in _SIGN.finditer(_STRING.sub('""', text)):
        own = sign.group()
        values += own in "[{,"
        level += (own in "[{") - (own in "]}")
        if level > limits.depth or values > limits.values:
            raise StrictJsonError(f"more than {limits.depth} levels or {limits.values} values")


def strict_json(text: str, limits: JsonLimits | None = None) -> Any:
    """Parse JSON in which every key occurs once in its object and every number is finite; limits are checked first."""
    if limits:
        check_limits(text, limits)

    def once(pairs: list[tuple[str, Any]]) -> dict:
        made = dict(pairs)
        if len(made) != len(pairs):
            names = [k for k, _ in pairs]
            raise StrictJsonError(f"key {next(k for k in names if names.count(k) > 1)!r} occurs twice")
        return made

    def finite(number: str) -> float:
        value = float(number)
        if not math.isfinite(value):
            raise StrictJsonError(f"number {number} is not finite")
        return value

    try:
        return json.loads(text, object_pairs_hook=once, parse_float=finite, parse_constant=finite)
    except (json.JSONDecodeError, RecursionError) as error:
        raise StrictJsonError(str(error)) from error


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, non-ASCII as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType = ARTIFACT) -> DataFrame:
    """Rows of a JSON Lines file or folder by a fixed schema; blank lines are skipped, bad ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON file that is one document."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def checked_lines(spark: SparkSession, path: str, limits: JsonLimits = JsonLimits()) -> DataFrame:  # noqa: B008 (frozen)
    """(file, line, text, canonical, error) of a JSON Lines file, each line judged by strict_json within the limits.

    Spark's own reader keeps the last of two equal keys without a word, so lines are
    read as text and parsed by Python in batches. Line numbers count within a file,
    so files are read whole; a corpus of large files should be written in many.
    """
    ship_package(spark)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("line", "text")).filter(F.trim("text") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canonical: list[str | None] = []
            errors: list[str | None] = []
            for text in batch.column("text").to_pylist():
                try:
                    canonical.append(canonical_json(strict_json(text, limits)))
                    errors.append(None)
                except (StrictJsonError, ValueError) as error:
                    canonical.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(canonical, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "canonical", "error"])

    return lines.withColumn("line", F.col("line") + 1).mapInArrow(run, "file string, line int, text string, canonical string, error string")


def strict_json_lines(spark: SparkSession, path: str, schema: str | T.StructType = ARTIFACT) -> DataFrame:
    """Rows of a JSON Lines file whose lines all pass strict_json; the first that doesn't is an error that names it."""
    lines = checked_lines(spark, path)
    where = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("error"))
    good = lines.select(F.when(F.col("error").isNull(), F.col("canonical")).otherwise(F.raise_error(where)).alias("canonical"))
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return good.select(F.from_json("canonical", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def registry(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """A lookup table, guarded: a key that is missing or occurs twice is an error when it is read."""
    checked = rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*rows.columns)).alias("__r"))
    ok = F.when(F.col(key).isNotNull() & (F.col("__n") == 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("registry key is missing or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return checked.filter(ok).select("__r.*")


def write_json_lines(rows: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """One JSON object a line with keys sorted, rows in the given order; refuses to replace what is there.

    The order holds across part files: they are sorted by range and read in order of
    their names.
    """
    named = rows.select(*sorted(rows.columns))
    lines = named.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_split(rows: DataFrame, path: str) -> None:
    """A split as one dataset with a folder for each partition."""
    rows.write.mode("errorifexists").partitionBy("partition").parquet(path)


def content_path(folder: str, content: Column) -> Column:
    """Where an immutable file of the given content belongs: its name is its digest."""
    return F.concat(F.lit(folder.rstrip("/") + "/sha256-"), F.sha2(content.cast("binary"), 256), F.lit(".json"))


def report(row: DataFrame) -> str:
    """A one-row report as indented JSON with sorted keys."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report is one row")
    return json.dumps(found[0].asDict(recursive=True), sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def tree_texts(value: Any, path: str = "$", keep: Callable[[str], bool] | None = None) -> Iterator[tuple[str, str]]:
    """(path, text) of every string anywhere in a JSON value."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for k, item in enumerate(value):
            yield from tree_texts(item, f"{path}[{k}]", keep)
    elif isinstance(value, dict):
        for k in sorted(value):
            if keep is None or keep(k):
                yield from tree_texts(value[k], f"{path}.{k}", keep)


def walked_texts(rows: DataFrame, key: str, json_column: str, most: int = 100_000) -> DataFrame:
    """(key, path, text) of every string in a column of JSON, whatever its depth; more than `most` in one value is an error."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(key).to_pylist(), batch.column(json_column).to_pylist(), strict=True):
                found = list(tree_texts(json.loads(text))) if text else []
                if len(found) > most:
                    raise ValueError(f"{name}: more than {most} strings in one value")
                out += [(name, p, t) for p, t in found]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(key).type), pa.array(b), pa.array(c)], names=[key, "path", "text"])

    return rows.select(key, json_column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, path string, text string")
