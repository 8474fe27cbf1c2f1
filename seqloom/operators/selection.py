"""Members that stand for their group, nested closures, and inputs that must pair off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.hashing import keyed_digest


def primary_members(rows: DataFrame, group: str, member: str, seed: int | str) -> DataFrame:
    """(group, member): of each group the member whose seeded digest comes first; equal digests go to the smaller member. Null members never stand for a group."""
    rank = F.struct(keyed_digest(seed, F.col(member).cast("string")).alias("d"), F.col(member).alias("m"))
    return rows.filter(F.col(member).isNotNull()).groupBy(group).agg(F.min(rank).alias("least")).select(group, F.col("least.m").alias(member))


def representatives(rows: DataFrame, family: str, member: str) -> DataFrame:
    """(family, member, replicas): the smallest member of each family, and how many rows it stands for."""
    return rows.groupBy(family).agg(F.min(member).alias(member), F.count("*").alias("replicas"))


def closure_report(closures: DataFrame) -> DataFrame:
    """One row per axis of closures (axis, group, member): groups, self_missing, same_members, crossing, valid.

    A group must hold itself, no two groups may hold the same members, a group that
    another one holds must lie in it as a whole, and groups that share a member must
    be nested. Around each member only groups next to each other in size are
    compared, which nests all of them, so pairs are no more than rows.
    """
    own = closures.select("axis", "group", "member").distinct()
    size = own.groupBy("axis", "group").agg(F.count("*").alias("size"), F.max((F.col("group") == F.col("member")).cast("int")).alias("itself"))
    sized = own.join(size, ["axis", "group"])
    around = W.partitionBy("axis", "member").orderBy("size", "group")
    beside = sized.select("axis", F.col("group").alias("small"), F.lead("group").over(around).alias("large")).filter("large IS NOT NULL")
    held = own.join(size.select("axis", F.col("group").alias("member")), ["axis", "member"]).filter(F.col("group") != F.col("member"))
    pairs = beside.union(held.select("axis", F.col("member").alias("small"), F.col("group").alias("large"))).distinct()
    inner = pairs.join(own.withColumnRenamed("group", "small"), ["axis", "small"])
    outer = own.select("axis", F.col("group").alias("large"), "member", F.lit(1).alias("both"))
    common = inner.join(outer, ["axis", "large", "member"], "left").groupBy("axis", "small", "large").agg(F.count("*").alias("n"), F.count("both").alias("both"))
    of_large = size.select("axis", F.col("group").alias("large"), F.col("size").alias("large_size"))
    judged = common.join(of_large, ["axis", "large"]).groupBy("axis").agg(F.count_if(F.col("both") < F.col("n")).alias("crossed"), F.count_if((F.col("both") == F.col("n")) & (F.col("n") == F.col("large_size"))).alias("same"))
    whole = size.groupBy("axis").agg(F.count("*").alias("groups"), F.count_if(F.col("itself") == 0).alias("self_missing")).join(judged, "axis", "left")
    same, crossing = F.coalesce("same", F.lit(0)) > 0, F.coalesce("crossed", F.lit(0)) > 0
    return whole.select("axis", "groups", "self_missing", same.alias("same_members"), crossing.alias("crossing"), ((F.col("self_missing") == 0) & ~same & ~crossing).alias("valid"))


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status) of each key: paired, missing (no row on the right), extra (none on the left) or repeated; rows without a key are unidentified."""
    one = left.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("a"))
    two = right.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("b"))
    status = F.when(F.col("key").isNull(), "unidentified").when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when((F.col("a") > 1) | (F.col("b") > 1), "repeated").otherwise("paired")
    return one.join(two, "key", "full_outer").select("key", status.alias("status"))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order: each is taken to 15 decimal places, up to 10^23 in all."""
    return F.sum(value.cast("decimal(28,15)")).cast("double")


def add_confusions(partials: DataFrame, states: list[str]) -> DataFrame:
    """(truth, predicted, mass): partial confusion masses added, cells without any as zero; states no axis knows and masses below zero are an error."""
    known = F.col("truth").isin(states) & F.col("predicted").isin(states) & (F.col("mass") >= 0) & ~F.isnan("mass")
    checked = F.when(known, F.col("mass")).otherwise(F.raise_error(F.lit("unknown state or bad mass")).cast("double"))
    added = partials.groupBy("truth", "predicted").agg(exact_sum(checked).alias("mass"))
    spark = partials.sparkSession
    cells = spark.createDataFrame([(a, b) for a in states for b in states], "truth string, predicted string")
    return F.broadcast(cells).join(added, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def paired_folds(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fold, delta, improved) of two tables (fold, score); a fold that only one of them has keeps nulls."""
    both = candidate.select("fold", F.col("score").alias("a")).join(baseline.select("fold", F.col("score").alias("b")), "fold", "full_outer")
    return both.select("fold", (F.col("a") - F.col("b")).alias("delta"), (F.col("a") > F.col("b")).alias("improved"))
