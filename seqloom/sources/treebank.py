"""Seven-column token documents from folders or archives, whole bad documents set aside with a reason."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.runtime import ship_package

COLUMNS = ["position", "form", "segm", "xpostag", "head", "deprel", "misc"]
HEADER = "# ID\tFORM\tSEGM\tXPOSTAG\tHEAD\tDEPREL\tMISC"
#: Limits of an archive: bytes of it, members, bytes of all members.
ARCHIVE_BYTES, ARCHIVE_MEMBERS, MEMBER_BYTES = 256 << 20, 10_000, 128 << 20


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the documents of a folder tree."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.conll").text(path, wholetext=True)
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.conll$", "").alias("name"), F.col("value").alias("text"))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the documents in ZIP or TAR archives; members with unsafe paths or beyond the limits are errors.

    An archive can't be split, so each is one task's work.
    """
    ship_package(spark)

    def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
        if len(raw) > ARCHIVE_BYTES:
            raise ValueError("the archive is too large")
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
                sizes, names = sum(i.file_size for i in infos), [i.filename for i in infos]
                found = ((i.filename, z.read(i)) for i in infos)
                yield from bounded(names, sizes, found)
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                infos = [i for i in t.getmembers() if not i.isdir()]
                if any(not i.isfile() for i in infos):
                    raise ValueError("the archive holds links or devices")
                found = ((i.name, t.extractfile(i).read()) for i in infos)
                yield from bounded([i.name for i in infos], sum(i.size for i in infos), found)

    def bounded(names: list[str], size: int, found: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        if len(names) > ARCHIVE_MEMBERS or size > MEMBER_BYTES or len(set(names)) != len(names):
            raise ValueError("the archive has too many, too large or repeated members")
        if any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names):
            raise ValueError("the archive holds a member outside its own folder")
        yield from found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                own = sorted((n.rsplit("/", 1)[-1].removesuffix(".conll"), b.decode("utf-8", "replace")) for n, b in members(raw) if n.endswith(".conll"))
                if own:
                    names, texts = zip(*own, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], names=["name", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, text string")


def parse(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens (name, visual_index, source_line, columns, classes) and set-aside documents (name, reason, line).

    A document is judged as a whole: its first bad line, or what it lacks, keeps all
    of it out. Everything is a split, an explode and aggregates by document.
    """
    lines = documents.select("name", F.posexplode(F.split("text", "\n")).alias("k", "raw")).withColumn("line", F.col("k") + 1)
    lines = lines.withColumn("raw", F.regexp_replace("raw", "\r$", ""))
    # The shape of all rows is judged first, comments left aside.
    shaped = lines.filter((F.col("raw") != "") & ~F.col("raw").startswith("#")).withColumn("n", F.size(F.split("raw", "\t", -1)))
    shape = shaped.groupBy("name").agg(F.count("*").alias("tokens"), F.min(F.when(F.col("n") != len(COLUMNS), F.col("line"))).alias("misshapen"))
    head = lines.groupBy("name").agg(F.max(F.when(F.col("line") == 1, F.col("raw"))).alias("first"), F.max(F.when(F.col("line") == 2, F.col("raw"))).alias("second"))
    body = lines.filter((F.col("line") > 2) & (F.col("raw") != "")).withColumn("f", F.split("raw", "\t", -1))
    wide = body.select("name", "line", "raw", F.size("f").alias("n"), *(F.get("f", k).alias(c) for k, c in enumerate(COLUMNS)))
    seen = F.row_number().over(W.partitionBy("name", "position").orderBy("line"))
    classes = F.array_compact(F.array(
        F.when(F.col("xpostag").rlike(r"^NU(\.|$)"), "quantity"), F.when(F.col("segm").contains("[unit]"), "unit"), F.when(F.col("xpostag").rlike(r"^PN(\.|$)"), "person_name"), F.when(F.col("xpostag").rlike(r"^SN(\.|$)"), "settlement_name")
    ))
    judged = wide.withColumn("classes", classes).withColumn("reason", F.when(F.col("raw").startswith("#"), "unsupported_comment").when(F.col("n") != len(COLUMNS), "non_7_column_row")
        .when(F.col("position").isNull() | (F.col("position") == "") | (F.trim("position") != F.col("position")), "invalid_token_position").when(seen > 1, "duplicate_token_position")
        .when(F.col("form").isNull() | (F.col("form") == "") | (F.trim("form") != F.col("form")), "invalid_form").when(F.col("raw").rlike("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), "forbidden_control_character").when(F.size("classes") > 1, "overlapping_gold_classes"))
    bad = judged.filter("reason IS NOT NULL").groupBy("name").agg(F.min(F.struct("line", "reason")).alias("b"))
    every = head.join(shape, "name", "left").join(bad, "name", "left")
    new_text = F.regexp_extract("first", r"^#new_text=(P[0-9]{6})\t*$", 1)
    reason = (
        F.when(F.col("misshapen").isNotNull(), "non_7_column_row").when(F.col("tokens").isNull(), "no_token_rows").when(~F.col("name").rlike("^P[0-9]{6}$"), "invalid_p_identifier")
        .when(new_text == "", "invalid_new_text").when(new_text != F.col("name"), "p_identifier_mismatch").when(F.col("second") != HEADER, "invalid_column_header").otherwise(F.col("b.reason"))
    )
    line = F.when(reason == "non_7_column_row", F.coalesce("misshapen", F.col("b.line"))).when(reason.isin("invalid_new_text", "p_identifier_mismatch"), 1).when(reason == "invalid_column_header", 2).when(reason.isin("no_token_rows", "invalid_p_identifier"), F.lit(None).cast("int")).otherwise(F.col("b.line"))
    aside = every.select("name", reason.alias("reason"), line.alias("line")).filter("reason IS NOT NULL")
    good = judged.join(aside.select("name"), "name", "left_anti")
    order = F.row_number().over(W.partitionBy("name").orderBy("line")) - 1
    return good.select("name", order.alias("visual_index"), F.col("line").alias("source_line"), *COLUMNS, F.get("classes", 0).alias("truth")), aside


def nested_lemmas(documents: DataFrame, name: str, json_column: str) -> DataFrame:
    """(name, line_ordinal, token_index, form, pos, gw) of documents of nested JSON nodes of any depth.

    A node "d" of type "line-start" opens a line, a node "l" is a lemma, "cdl" holds
    nodes below. The depth has no bound, so Python walks each document.
    """
    import json

    ship_package(documents.sparkSession)

    def lemmas(nodes: list) -> Iterator[tuple]:
        line, token, stack = -1, 0, [iter(nodes)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
                continue
            if node.get("node") == "d" and node.get("type") == "line-start":
                line += 1
            if node.get("node") == "l":
                if line < 0:
                    raise ValueError("a lemma stands before the first line")
                f = node.get("f") or {}
                yield line, token, f.get("form"), f.get("pos"), f.get("gw")
                token += 1
            if node.get("cdl"):
                stack.append(iter(node["cdl"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, *row) for n, text in zip(batch.column(name).to_pylist(), batch.column(json_column).to_pylist(), strict=True) for row in lemmas(json.loads(text)["cdl"])]
            if out:
                columns = zip(*out, strict=True)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[name, "line_ordinal", "token_index", "form", "pos", "gw"])

    return documents.select(name, json_column).mapInArrow(run, f"{name} string, line_ordinal int, token_index int, form string, pos string, gw string")


def lemma_truth(pos, gw):
    """The class of a lemma by its part of speech and guide word; annotation_unknown where they don't tell."""
    return (
        F.when(pos.isNull() | ((pos == "N") & gw.isNull()), "annotation_unknown").when(pos == "n", "quantity").when((pos == "N") & (gw == "unit"), "unit")
        .when(pos == "PN", "person_name").when(pos == "SN", "settlement_name").otherwise("context_only")
    )
