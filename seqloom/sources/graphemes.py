"""Folder trees of grapheme files, one JSON file an artifact, as nested artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = "array<struct<id:string,description:string,graphemes:array<struct<id:string,features:array<int>>>>>"
#: Reading order against the physical one is an inference of the source for its whole corpus.
DIRECTION = "right_to_left"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(artifact_id, sides, warnings, record_hash) of every file below path.

    features are damage, line number, uncertainty from 0 to 100. Graphemes of a side
    fall into lines by their line number and keep their order; reading_index runs
    against it, confidence is (100 - uncertainty) / 100, any damage makes a token
    damaged. Damage above 100 is kept and warned of; uncertainty above 100 is an error.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = files.select(F.regexp_replace(F.upper(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")), r"^([A-Z]+)([0-9])", "$1-$2").alias("artifact_id"), F.sha2("value", 256).alias("record_hash"), F.from_json("value", SIDES, {"mode": "FAILFAST"}).alias("raw"))
    marks = parsed.select("artifact_id", "record_hash", F.posexplode("raw").alias("side_no", "side")).select(
        "artifact_id", "record_hash", "side_no", F.col("side.id").alias("side_id"), F.col("side.description").alias("description"), F.posexplode("side.graphemes").alias("upstream_index", "g")
    )
    damage, line, doubt = F.get("g.features", 0), F.get("g.features", 1), F.get("g.features", 2)
    checked = F.when(doubt <= 100, doubt).otherwise(F.raise_error(F.concat(F.lit("uncertainty above 100 in "), "artifact_id")).cast("int"))
    tokens = marks.select("artifact_id", "record_hash", "side_no", "side_id", "description", "upstream_index", F.col("g.id").alias("sign_id"), damage.alias("damage"), line.alias("line_number"), checked.alias("doubt"))
    lines = tokens.groupBy("artifact_id", "record_hash", "side_no", "side_id", "description", "line_number").agg(F.array_sort(F.collect_list(F.struct("upstream_index", "sign_id", "damage", "doubt"))).alias("own"))
    placed = F.transform(
        "own",
        lambda t, i: F.struct(
            F.concat(F.col("side_id"), F.lit(":L"), F.col("line_number").cast("string"), F.lit(":T"), (t["upstream_index"] + 1).cast("string")).alias("token_id"), t["sign_id"].alias("sign_id"), i.alias("visual_index"),
            (F.size("own") - i - 1).alias("reading_index"), ((100 - t["doubt"]) / 100).alias("confidence"), F.when(t["damage"] == 0, "clear").otherwise("damaged").alias("condition"),
            F.struct(F.when(t["doubt"] == 0, "clear").otherwise("uncertain").alias("status")).alias("uncertainty"),
        ),
    )
    line_struct = F.struct("line_number", F.concat(F.col("side_id"), F.lit(":L"), F.col("line_number").cast("string")).alias("line_id"), F.lit(DIRECTION).alias("reading_direction"), placed.alias("tokens"))
    warned = F.filter(F.transform("own", lambda t: F.when(t["damage"] > 100, F.struct(F.lit("damage_out_of_documented_range").alias("code"), t["damage"].alias("raw_value")))), lambda w: w.isNotNull())
    sides = lines.select("artifact_id", "record_hash", "side_no", "side_id", "description", line_struct.alias("line"), warned.alias("warned")).groupBy("artifact_id", "record_hash", "side_no", "side_id", "description").agg(
        F.array_sort(F.collect_list("line")).alias("lines"), F.flatten(F.collect_list("warned")).alias("warned")
    )
    return sides.groupBy("artifact_id", "record_hash").agg(
        F.array_sort(F.collect_list(F.struct("side_no", "side_id", "description", "lines"))).alias("sides"), F.flatten(F.collect_list("warned")).alias("warnings")
    )
