"""Synthetic known-script corpora: families of lines whose classes have set places, made in parallel by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.hashing import event_uniform

CLASSES = ["quantity", "unit", "person_name", "settlement_name"]
SITES, OBJECTS = 6, 4


def known_script(spark: SparkSession, families: int = 96, least: int = 6, most: int = 11, forms: int = 12, seed: int = 0) -> DataFrame:
    """(family, artifact_id, site, object_type, pos, truth, form): a line of least to most tokens for each family.

    A quantity opens a line and a unit follows it; the other places are names by
    chance. A class has its own forms, the first of them the most frequent. Every
    choice is a digest of seed, family and place, so any number of families can be
    made by any number of tasks.
    """
    rows = spark.range(families).withColumn("family", F.concat(F.lit("family-"), F.lpad(F.col("id").cast("string"), 8, "0")))
    length = least + F.floor(event_uniform("length", seed, F.col("family")) * (most - least + 1)).cast("int")
    tokens = rows.withColumn("n", length).withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n"))))
    name = F.when(event_uniform("class", seed, F.col("family"), F.col("pos")) < 0.6, CLASSES[2]).otherwise(CLASSES[3])
    truth = F.when(F.col("pos") == 1, CLASSES[0]).when(F.col("pos") == 2, CLASSES[1]).otherwise(name)
    u = event_uniform("form", seed, F.col("family"), F.col("pos"))
    tokens = tokens.withColumn("truth", truth).withColumn("form", F.concat("truth", F.lit("-"), F.floor(u * u * forms).cast("string")))
    pick = lambda what, n: F.concat(F.lit(f"{what}-"), F.floor(event_uniform(what, seed, F.col("family")) * n).cast("string"))
    return tokens.select("family", F.col("family").alias("artifact_id"), pick("site", SITES).alias("site"), pick("object", OBJECTS).alias("object_type"), "pos", "truth", "form")
