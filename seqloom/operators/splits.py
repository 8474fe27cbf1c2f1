"""Deterministic splits that keep families and leakage components whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.graph import connected_components
from seqloom.operators.ranking import holdout_size, lowest
from seqloom.runtime import Scratch


def group_split(rows: DataFrame, key: str, fraction: float = 0.2, seed: int | str = 0) -> DataFrame:
    """rows with partition train or test: the groups whose seeded digests come first are test.

    The fraction is of groups, not of rows. The set of test groups may be large,
    so it is joined as Spark sees fit, never forced into a broadcast.
    """
    groups = rows.select(key).distinct()
    test = lowest(groups, key, seed, holdout_size(groups.count(), fraction)).withColumn("__test", F.lit(True))
    return rows.join(test, key, "left").withColumn("partition", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def leakage_components(evidence: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(artifact, component) from (artifact, kind, value): artifacts that share evidence belong together.

    Evidence held by one artifact alone links nothing and is dropped before the
    graph. A value held by many links them in a star to the smallest, so links
    are no more than evidence rows, however common a value is.
    """
    spark = evidence.sparkSession
    scratch = scratch or Scratch(spark, "leakage")
    own = scratch.keep(evidence.select("artifact", "kind", "value").distinct(), "evidence")
    least = own.groupBy("kind", "value").agg(F.min("artifact").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    links = own.join(least, ["kind", "value"]).filter("artifact <> centre").select(F.col("artifact").alias("u"), F.col("centre").alias("v"))
    joined = connected_components(spark, links.distinct(), scratch)
    artifacts = own.select("artifact").distinct()
    return artifacts.join(joined, artifacts["artifact"] == joined["node"], "left").select("artifact", F.coalesce("component", "artifact").alias("component"))


def component_keys(components: DataFrame) -> DataFrame:
    """components with the digest of their sorted members as a key, independent of any numbering.

    A component with very many members would make a very long key, so members are
    digested one by one and the sorted digests once more.
    """
    member = F.sha2(F.col("artifact").cast("string"), 256)
    keys = components.groupBy("component").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(member)), ","), 256).alias("component_key"))
    return components.join(keys, "component")


def leave_one_out(rows: DataFrame, group: str, family: str) -> DataFrame:
    """rows once for each held-out group, with partition: families of the held-out group are test as a whole."""
    held = rows.select(F.col(group).alias("held_out"), F.col(family).alias("__family")).distinct()
    groups = rows.select(F.col(group).alias("held_out")).distinct()
    every = rows.join(groups)  # a row for each group is the result asked for
    same = (every[family] == held["__family"]) & (every["held_out"] == held["held_out"])
    test = every.join(held, same, "left_semi").withColumn("partition", F.lit("test"))
    train = every.join(held, same, "left_anti").withColumn("partition", F.lit("train"))
    return test.unionByName(train)


def leave_one_out_counts(rows: DataFrame, group: str, family: str) -> DataFrame:
    """(held_out, test_rows, train_rows, test_families) without repeating the rows for each group."""
    total = rows.count()
    sizes = rows.groupBy(F.col(family).alias("f")).agg(F.count("*").alias("n"))
    held = rows.select(F.col(group).alias("held_out"), F.col(family).alias("f")).distinct()
    return (
        held.join(sizes, "f")
        .groupBy("held_out")
        .agg(F.sum("n").alias("test_rows"), F.count("*").alias("test_families"))
        .withColumn("train_rows", F.lit(total).cast("bigint") - F.col("test_rows"))
    )
