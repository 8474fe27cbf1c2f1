"""Commitments: digests of trees, models and corpora that don't depend on order, and what differs from them."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_free_digest(rows: DataFrame, digest: Column, most: float = 1 << 16) -> DataFrame:
    """One row (digest, rows): row digests sorted and digested by their first letters, and those by fewer letters until one is left.

    The letters follow from the number of rows, three for up to most * 16^3 of them
    and three more for each 16^3 times as many, so that a group holds about `most`
    row digests, or 16^3 digests of groups, in a table of any size.
    """
    total, letters = rows.count(), 3
    while total > most * 16**letters:
        letters += 3
    parts = rows.select(digest.alias("d")).groupBy(F.substring("d", 1, letters).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("part"), F.count("*").alias("n"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda x: x["part"]), ""), 256)
    while letters > 3:
        letters -= 3
        parts = parts.groupBy(F.substring("p", 1, letters).alias("q")).agg(joined.alias("part"), F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return parts.agg(joined.alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def tree_commitment(inventory: DataFrame, root: str) -> DataFrame:
    """One row (digest, rows, bytes) of a file inventory, paths taken below root."""
    path = F.regexp_replace("file", "^.*" + root.strip("/").replace(".", r"\.") + "/", "")
    rows = inventory.select(F.sha2(F.concat_ws("\0", path, F.col("bytes").cast("string"), F.col("content_sha256")), 256).alias("h"), "bytes")
    total = inventory.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return order_free_digest(rows, F.col("h")).crossJoin(total)  # one row each


def differences(inventory: DataFrame, committed: DataFrame) -> DataFrame:
    """(file, problem) of files that are missing, extra or changed against a committed inventory; none if it holds."""
    now = inventory.select("file", F.col("content_sha256").alias("now"))
    then = committed.select("file", F.col("content_sha256").alias("then"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "file", "full_outer").select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def state_commitment(state: Any) -> str:
    """Digest of a model's state as canonical JSON."""
    return hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def observation_commitment(tokens: DataFrame, document: str, line: str) -> DataFrame:
    """An order-free digest of what can be seen of a corpus: forms enter only by where equal ones stand in a document."""
    from pyspark.sql import Window as W

    own = W.partitionBy(document)
    first = F.min(F.struct(line, "pos")).over(W.partitionBy(document, "form"))
    coded = tokens.withColumn("__first", F.when(F.col("form").isNotNull(), first))
    coded = coded.withColumn("__code", F.when(F.col("form").isNotNull(), F.dense_rank().over(own.orderBy(F.col("__first").asc_nulls_last()))))
    seen = F.struct(line, "pos", F.coalesce("__code", F.lit(0)).alias("c"), "damaged")
    rows = coded.groupBy(document).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(seen))), 256).alias("h"))
    return order_free_digest(rows, F.col("h"))
