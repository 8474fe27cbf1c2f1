"""Rank statistics over as many rows as overflow 64-bit sums, against Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import rank_statistics
from seqloom.plans import statistics

ROWS = 90_000


def _state(left, right):
    """Covariance and variances of doubled midranks."""

    def ranks(values):
        kinds, back, n = np.unique(values, return_inverse=True, return_counts=True)
        return (2 * np.cumsum(n) - n + 1)[back].astype(object)

    x, y = ranks(left), ranks(right)
    return tuple(len(x) * int((a * b).sum()) - int(a.sum()) * int(b.sum()) for a, b in ((x, y), (x, x), (y, y)))


def _resampled(run):
    """rho of one run over rows (cell, key, left, right) = (k % 3, k, k, k % 7)."""
    drawn = []
    for cell in range(3):
        own = range(cell, ROWS, 3)
        drawn += [own[int(hashlib.sha256(f"0|{run}|c{cell}|{i}".encode()).hexdigest()[:12], 16) % len(own)] for i in range(len(own))]
    c, x, y = _state(np.array(drawn), np.array(drawn) % 7)
    return c / (math.sqrt(x) * math.sqrt(y))


def test_resamples_of_many_rows(spark):
    rows = spark.range(ROWS).select(F.concat(F.lit("c"), F.col("id") % 3).alias("cell"), F.col("id").alias("key"), F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    got = {r.run: (r.status, r.rho) for r in rank_statistics.paired_bootstrap(rows, "cell", "key", "a", "b", 2).collect()}
    assert {k: s for k, (s, _) in got.items()} == {0: "defined", 1: "defined"}
    assert all(abs(rho - _resampled(run)) < 1e-12 for run, (_, rho) in got.items())


def test_endpoint_of_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(statistics, "BOOTSTRAP_RUNS", 3)
    k = F.col("id")
    spark.range(ROWS).select(k.alias("c_custkey"), F.concat(F.lit("c"), k % 3).alias("c_mktsegment"), k.cast("double").alias("c_acctbal"), k.cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = statistics.bootstrap_endpoint(spark, str(tmp_path)).first()
    assert got.place == 3 and abs(got.lower - max(_resampled(run) for run in range(3))) < 1e-6


def test_threshold_of_many_rows(spark, tmp_path):
    many = np.arange(ROWS * 3 // 2)
    owner, price = many % ROWS, many * 7919 % ROWS
    rows = F.col("id")
    spark.range(len(many)).select((rows % ROWS).alias("o_custkey"), (rows * 7919 % ROWS * 100).cast("double").alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    largest = np.zeros(ROWS, np.int64)
    np.maximum.at(largest, owner, price)
    c, x, y = _state(np.bincount(owner), largest)
    rho = c / (math.sqrt(x) * math.sqrt(y))
    got = statistics.spearman_threshold(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.rho == pytest.approx(rho, abs=1e-9) and r.relation == (1 if rho > r.a / r.b else -1) for r in got)


def test_endpoint_keeps_absent_values(spark, tmp_path):
    k = F.col("id")
    spark.range(200).select(k.alias("c_custkey"), F.concat(F.lit("c"), k % 3).alias("c_mktsegment"), F.when(k % 5 > 0, (k * 37 % 101).cast("double")).alias("c_acctbal"), F.when(k % 4 > 0, k.cast("int")).alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = statistics.bootstrap_endpoint(spark, str(tmp_path)).first()
    assert (got.lower, got.place) == sql.execute(statistics.ENDPOINT_SQL).fetchone()
