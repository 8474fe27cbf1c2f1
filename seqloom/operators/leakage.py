"""Leakage between partitions: evidence that both sides hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import attach


def overlaps(evidence: DataFrame) -> DataFrame:
    """(kind, value, partition, artifact) of evidence (artifact, kind, value, partition) on both sides: an inverted index in rows.

    Values are counted by side first; a value that very many artifacts hold makes
    many rows, never one long list, and is sent to them rather than gathered.
    """
    own = evidence.select("artifact", "kind", "value", "partition").distinct()
    sides = own.groupBy("kind", "value").agg(F.count_if(F.col("partition") == "train").alias("a"), F.count_if(F.col("partition") == "test").alias("b"), F.count("*").alias("n"))
    key = F.struct("kind", "value").alias("key")
    shared = attach(own.select(key, "partition", "artifact"), sides.filter("a > 0 AND b > 0").select(key, "n"), "key", "n", own.count())
    return shared.select("key.kind", "key.value", "partition", "artifact")


def report(evidence: DataFrame) -> DataFrame:
    """(kind, findings, train_artifacts, test_artifacts): how much evidence of each kind both sides share."""
    own = evidence.distinct()
    sides = own.groupBy("kind", "value").agg(F.count_if(F.col("partition") == "train").alias("a"), F.count_if(F.col("partition") == "test").alias("b"))
    return sides.filter("a > 0 AND b > 0").groupBy("kind").agg(F.count("*").alias("findings"), F.sum("a").alias("train_links"), F.sum("b").alias("test_links"))


def unseen(rows: DataFrame, sequence: str) -> DataFrame:
    """Test rows whose sequence no train row has, all columns kept; only distinct train sequences are matched. A null sequence counts as unseen."""
    train = rows.filter(F.col("partition") == "train").select(sequence).distinct()
    return rows.filter(F.col("partition") == "test").join(train, sequence, "left_anti").select(rows.columns)
