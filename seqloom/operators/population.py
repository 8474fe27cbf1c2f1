"""Populations of related units: closure under relations, exclusions, contexts, invariants, state ladders, pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.hashing import hmac_sha256
from seqloom.operators.graph import connected_components
from seqloom.runtime import Scratch

#: Why a component is left out; the first that holds counts.
PRECEDENCE = ["prior_exposure", "conflict", "dependence"]


def closed_components(units: DataFrame, relations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(unit, component, excluded) of units under relations (left, right, kind).

    union joins two units; exclude_both leaves out both their components as a
    conflict. A unit without relations is its own component.
    """
    spark = units.sparkSession
    scratch = scratch or Scratch(spark, "population")
    joined = connected_components(spark, relations.filter("kind = 'union'").select(F.col("left").alias("u"), F.col("right").alias("v")), scratch)
    own = units.select("unit").join(joined, F.col("unit") == F.col("node"), "left").select("unit", F.coalesce("component", "unit").alias("component"))
    own = scratch.keep(own, "own")
    named = relations.filter("kind = 'exclude_both'").select(F.explode(F.array("left", "right")).alias("unit"))
    bad = own.join(named.distinct(), "unit", "left_semi").select("component").distinct().withColumn("excluded", F.lit(True))
    return own.join(bad, "component", "left").select("unit", "component", F.coalesce("excluded", F.lit(False)).alias("excluded"))


def exclusion_reasons(members: DataFrame) -> DataFrame:
    """(component, reason) by the first of PRECEDENCE that any member has (boolean columns of those names), null for none."""
    flags = members.groupBy("component").agg(*(F.bool_or(p).alias(p) for p in PRECEDENCE))
    reason = None
    for p in PRECEDENCE:
        reason = F.when(F.col(p), p) if reason is None else reason.when(F.col(p), p)
    return flags.select("component", reason.alias("reason"))


def component_contexts(members: DataFrame, axes: list[str], eligible: str) -> DataFrame:
    """For each component and axis: contexts of all members, and of eligible ones, sorted."""
    sets = []
    for axis in axes:
        sets += [F.array_sort(F.collect_set(axis)).alias(axis), F.array_sort(F.collect_set(F.when(F.col(eligible), F.col(axis)))).alias(f"{axis}_trigger")]
    return members.groupBy("component").agg(*sets)


def population_issues(records: DataFrame, key: str, order: str) -> DataFrame:
    """(key, code) of keys that repeat, and one row if the order numbers aren't 0 to n - 1."""
    twice = records.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).cast("string").alias("value"), F.lit("duplicate_id").alias("code"))
    order_row = records.agg(F.count("*").alias("n"), F.count_distinct(order).alias("k"), F.min(order).alias("a"), F.max(order).alias("b"))
    gap = order_row.filter("n > 0 AND (k <> n OR a <> 0 OR b <> n - 1)").select(F.lit(None).cast("string").alias("value"), F.lit("source_order_not_consecutive").alias("code"))
    return twice.unionByName(gap)


def first_failure(checks: list[tuple[str, Column]], passed: str) -> Column:
    """The state of the first check that fails; a null check fails."""
    out = None
    for state, ok in checks:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, state) if out is None else out.when(failed, state)
    return out.otherwise(passed)


def pseudonyms(rows: DataFrame, key: str, secret: bytes, prefix: str) -> DataFrame:
    """rows with opaque_id, a keyed digest of key; repeated is true where a key occurs more than once."""
    digest = F.concat(F.lit(f"{prefix}:"), hmac_sha256(secret, F.col(key).cast("string")))
    return rows.withColumn("opaque_id", digest).withColumn("repeated", F.count("*").over(W.partitionBy("opaque_id")) > 1)
