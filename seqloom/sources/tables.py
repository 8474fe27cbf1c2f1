"""Adapters that give the star-schema and text tables the shape of a sequence corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.sequences import positions

#: Events below this value count as damaged: their sign can't be read.
DAMAGED_BELOW = 5.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is an artifact, each event a token in time order; low values are damaged."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    tokens = events.select(
        F.col("user_id").cast("string").alias("artifact_id"),
        F.concat(F.lit("family:"), F.col("user_id").cast("string")).alias("family"),
        F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("site"),
        "event_id",
        "ts",
        "value",
        F.when(F.col("value") >= DAMAGED_BELOW, F.col("event_type")).alias("sign"),
        F.col("event_type").alias("truth"),
    )
    return positions(tokens, ["artifact_id"], ["ts", "event_id"])


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens in lines: a user's events of one day, with line_no and pos within the line."""
    tokens = event_tokens(spark, sf_dir).drop("pos").withColumn("day", F.to_date("ts"))
    return positions(tokens, ["artifact_id", "day"], ["ts", "event_id"])


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is an artifact; a line is a non-empty line of its text, white space collapsed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cut = docs.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return cut.withColumn("line", F.trim(F.regexp_replace("raw", r"[ \t\r]+", " "))).filter("line <> ''").drop("raw")
