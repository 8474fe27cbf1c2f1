"""Row numbers over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.hashing import keyed_digest
from seqloom.runtime import Scratch


def numbered(df: DataFrame, order: list[Column], name: str = "rn", scratch: Scratch | None = None) -> DataFrame:
    """df with 1, 2, ... in the given total order.

    A range-partitioned sort deals rows to many tasks; each adds how many rows the
    partitions before it hold. Only one count for each partition reaches the driver.
    """
    scratch = scratch or Scratch(df.sparkSession, "numbered")
    placed = scratch.keep(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33)
    sizes = sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    if not before:
        return placed.withColumn(name, F.lit(0).cast("bigint")).drop("__at")
    first = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "__p bigint, __before bigint"))
    return placed.join(first, part == first["__p"]).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__p", "__before")


def holdout_size(groups: int, fraction: float) -> int:
    """How many of the groups a fraction takes: halves round up, and both sides keep at least one."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be between 0 and 1")
    if fraction in (0.0, 1.0):
        return int(groups * fraction)
    if groups < 2:
        raise ValueError("a fraction between 0 and 1 needs at least two groups")
    return min(groups - 1, max(1, int(groups * fraction + 0.5)))


def lowest(groups: DataFrame, key: str, seed: int | str, k: int) -> DataFrame:
    """The k keys whose digests come first. A cut-off digest is found by counting buckets, so no global sort is needed."""
    ranked = groups.select(key, keyed_digest(seed, F.col(key)).alias("__digest"))
    if k <= 0:
        return groups.select(key).limit(0)
    bucket = F.substring("__digest", 1, 3)  # 4096 buckets
    counts = sorted((r.b, r.n) for r in ranked.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    taken, edge = 0, None
    for b, n in counts:
        if taken + n >= k:
            edge = b
            break
        taken += n
    if edge is None:
        return groups.select(key)
    within = ranked.filter(bucket == edge).orderBy("__digest", key).limit(k - taken)
    return ranked.filter(bucket < edge).select(key).unionByName(within.select(key))


def running_total(df: DataFrame, order: list[Column], amount: str, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df with the sum of amount over all rows up to each in the given total order, without a single-task window.

    Rows are sorted by range and summed within each partition; what the partitions
    before it hold is added from one row for each partition.
    """
    scratch = scratch or Scratch(df.sparkSession, "running")
    placed = scratch.keep(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.spark_partition_id()), "sorted")
    parts = sorted((r["__p"], r.s) for r in placed.groupBy("__p").agg(F.sum(amount).alias("s")).collect())
    before, total = [], 0
    for p, s in parts:
        before.append((p, total))
        total += s
    first = F.broadcast(df.sparkSession.createDataFrame(before, "__p int, __before bigint"))
    within = F.sum(amount).over(W.partitionBy("__p").orderBy("__at").rowsBetween(W.unboundedPreceding, 0))
    return placed.join(first, "__p").withColumn(name, within + F.col("__before")).drop("__at", "__p", "__before")
