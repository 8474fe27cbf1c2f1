"""Exact-statistics queries: ranks, correlations, scores, units, selector, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.exact import product, rho_at_least, rho_text
from seqloom.operators import rank_statistics as rs
from seqloom.runtime import Scratch
from seqloom.sources.tables import table

BOOTSTRAP_RUNS = 100


def doubled_midranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the average rank of each order's total price in whole hundreds, where ties are common."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).alias("hundreds"))
    return rs.doubled_midranks(orders, "hundreds", "doubled_rank").select("o_orderkey", "doubled_rank")


MIDRANK_SQL = """WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice / 100) AS BIGINT) AS h FROM orders)
SELECT o_orderkey, 2 * rank() OVER (ORDER BY h) + count(*) OVER (PARTITION BY h) - 1 AS doubled_rank FROM o"""


def _customer_pairs(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """For each customer the number of orders and the largest price in hundreds, ranked."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 100).alias("h"))
    each = scratch.keep(orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("h").alias("largest")), "each")
    left = rs.doubled_midranks(each, "orders", "r_orders", scratch)
    return rs.doubled_midranks(left, "largest", "r_largest", scratch)


def spearman_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "spearman")
    state = rs.spearman_state(_customer_pairs(spark, sf_dir, scratch), "r_orders", "r_largest")
    return state.select("n", *(F.col(c).cast("string").alias(c) for c in ("covariance", "variance_left", "variance_right")), "status")


PAIRS = """WITH c AS (SELECT o_custkey, count(*) AS a, max(CAST(floor(o_totalprice / 100) AS BIGINT)) AS b FROM orders GROUP BY o_custkey),
r AS (SELECT CAST(2 * rank() OVER (ORDER BY a) + count(*) OVER (PARTITION BY a) - 1 AS HUGEINT) AS x, CAST(2 * rank() OVER (ORDER BY b) + count(*) OVER (PARTITION BY b) - 1 AS HUGEINT) AS y FROM c),
s AS (SELECT count(*) AS n, count(*) * sum(x * y) - sum(x) * sum(y) AS cov, count(*) * sum(x * x) - sum(x) * sum(x) AS vx, count(*) * sum(y * y) - sum(y) * sum(y) AS vy FROM r)"""
SPEARMAN_SQL = f"""{PAIRS} SELECT n, CAST(cov AS VARCHAR) AS covariance, CAST(vx AS VARCHAR) AS variance_left, CAST(vy AS VARCHAR) AS variance_right,
CASE WHEN n < 2 THEN 'undefined_insufficient_observations' WHEN vx = 0 AND vy = 0 THEN 'undefined_zero_variance_both' WHEN vx = 0 THEN 'undefined_zero_variance_left' WHEN vy = 0 THEN 'undefined_zero_variance_right' ELSE 'defined' END AS status FROM s"""


def spearman_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rho to 12 places and its exact order against thresholds, by Python integers on one row."""
    scratch = Scratch(spark, "threshold")
    state = rs.spearman_state(_customer_pairs(spark, sf_dir, scratch), "r_orders", "r_largest")
    row = state.select(F.col("covariance").cast("string").alias("c"), product(F.col("variance_left").cast("string"), F.col("variance_right").cast("string")).alias("r"))
    limits = spark.createDataFrame([(1, 10), (2, 5), (9, 10)], "a int, b int")
    return row.crossJoin(F.broadcast(limits)).select("a", "b", rho_at_least("c", "r", "a", "b").alias("relation"), F.round(rho_text("c", "r").cast("double"), 9).alias("rho"))


THRESHOLD_SQL = f"""{PAIRS}, l(a, b) AS (VALUES (1, 10), (2, 5), (9, 10)), q AS (SELECT a, b, cov / (sqrt(CAST(vx AS DOUBLE)) * sqrt(CAST(vy AS DOUBLE))) AS rho FROM s, l)
SELECT a, b, CASE WHEN rho > a / b::DOUBLE THEN 1 WHEN rho < a / b::DOUBLE THEN -1 ELSE 0 END AS relation, round(rho, 9) AS rho FROM q"""


def additive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order: summed quantities, how many and how many kinds of its lines that weren't returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_partkey")
    return rs.additive_score(lines, ["l_orderkey"], F.col("l_quantity").cast("bigint"), F.col("l_returnflag") != "R", F.col("l_partkey"))


ADDITIVE_SQL = """SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS score, count(*) FILTER (l_returnflag <> 'R') AS l_total,
count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS l_distinct FROM lineitem GROUP BY l_orderkey"""


def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail prices in cents per size, converted by brand into lowest terms; brands without a rule stay unknown."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("unit"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("numerator"), F.greatest("p_size", F.lit(1)).cast("bigint").alias("denominator"))
    rules = spark.createDataFrame([(f"Brand#{k}", k + 3, 2 * k + 1) for k in range(1, 5)], "unit string, m_numerator bigint, m_denominator bigint")
    found = rs.convert_units(parts, F.broadcast(rules), "unit")  # four rules
    return found.select("p_partkey", "known", "value_numerator", "value_denominator")


UNIT_SQL = """WITH p AS (SELECT p_partkey, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS n, CAST(greatest(p_size, 1) AS BIGINT) AS d, CAST(substr(p_brand, 7) AS BIGINT) AS k FROM part),
q AS (SELECT p_partkey, k BETWEEN 1 AND 4 AS known, n * (k + 3) AS a, d * (2 * k + 1) AS b FROM p)
SELECT p_partkey, known, CASE WHEN known THEN a // gcd(a, b) END AS value_numerator, CASE WHEN known THEN b // gcd(a, b) END AS value_denominator FROM q"""

AXES = ["nation", "segment", "band"]


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_nationkey") % 9).cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor((F.col("c_acctbal") + 1000) / 1500).cast("string").alias("band"))


def domain_tuple_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feasible tuple of groups with its cells taken in axis order, and the one the nonce draws."""
    found = rs.select_tuples(_components(spark, sf_dir), AXES, 5, 20, 5)
    drawn = rs.ticket(found, AXES, "nonce").select(*(f"t_{a}" for a in AXES)).withColumn("drawn", F.lit(True))
    return found.join(F.broadcast(drawn), [f"t_{a}" for a in AXES], "left").withColumn("drawn", F.coalesce("drawn", F.lit(False)))  # one row is drawn


SELECTOR_SQL = """WITH c AS (SELECT CAST(c_nationkey % 9 AS VARCHAR) AS nation, c_mktsegment AS segment, CAST(CAST(floor((c_acctbal + 1000) / 1500) AS BIGINT) AS VARCHAR) AS band FROM customer),
a AS (SELECT nation AS t_nation FROM c GROUP BY nation HAVING count(*) >= 5), b AS (SELECT segment AS t_segment FROM c GROUP BY segment HAVING count(*) >= 5), d AS (SELECT band AS t_band FROM c GROUP BY band HAVING count(*) >= 5),
s AS (SELECT t_nation, t_segment, t_band, count(*) FILTER (nation = t_nation) AS n_nation, count(*) FILTER (nation <> t_nation AND segment = t_segment) AS n_segment,
      count(*) FILTER (nation <> t_nation AND segment <> t_segment AND band = t_band) AS n_band, count(*) FILTER (nation <> t_nation AND segment <> t_segment AND band <> t_band) AS rest FROM a, b, d, c GROUP BY ALL),
f AS (SELECT *, n_nation + n_segment + n_band AS holdout, sha256('nonce|' || t_nation || '|' || t_segment || '|' || t_band) AS k FROM s WHERE n_nation >= 5 AND n_segment >= 5 AND n_band >= 5 AND n_nation + n_segment + n_band >= 20 AND rest >= 5)
SELECT t_nation, t_segment, t_band, n_nation, n_segment, n_band, rest, holdout, k = min(k) OVER () AS drawn FROM f"""


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor("c_acctbal").alias("balance"), (F.col("c_nationkey") % 7).cast("bigint").alias("level"))
    return rs.paired_bootstrap(c, "c_mktsegment", "c_custkey", "balance", "level", BOOTSTRAP_RUNS)


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of each stratified resample of customers."""
    return _bootstrap(spark, sf_dir).select("run", "status", F.round("rho", 6).alias("rho"))


BOOTSTRAP = f"""WITH p AS (SELECT c_mktsegment AS cell, CAST(floor(c_acctbal) AS BIGINT) AS l, c_nationkey % 7 AS r, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
d AS (SELECT run, cell, CAST('0x' || substr(sha256('0|' || run || '|' || cell || '|' || i), 1, 12) AS BIGINT) % n AS j FROM p, (SELECT range AS run FROM range({BOOTSTRAP_RUNS}))),
s AS (SELECT run, l, r FROM d JOIN p ON p.cell = d.cell AND p.i = d.j),
k AS (SELECT run, CAST(2 * rank() OVER (PARTITION BY run ORDER BY l) + count(*) OVER (PARTITION BY run, l) - 1 AS HUGEINT) AS x, CAST(2 * rank() OVER (PARTITION BY run ORDER BY r) + count(*) OVER (PARTITION BY run, r) - 1 AS HUGEINT) AS y FROM s),
m AS (SELECT run, count(*) * sum(x * y) - sum(x) * sum(y) AS cov, count(*) * sum(x * x) - sum(x) * sum(x) AS vx, count(*) * sum(y * y) - sum(y) * sum(y) AS vy FROM k GROUP BY run),
z AS (SELECT run, CASE WHEN vx > 0 AND vy > 0 THEN 'defined' ELSE 'substituted' END AS status, CASE WHEN vx > 0 AND vy > 0 THEN CAST(cov AS DOUBLE) / (sqrt(CAST(vx AS DOUBLE)) * sqrt(CAST(vy AS DOUBLE))) ELSE -1 END AS rho FROM m)"""
BOOTSTRAP_SQL = f"{BOOTSTRAP} SELECT run, status, round(rho, 6) AS rho FROM z"


def bootstrap_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower endpoint: the third smallest of 100 runs."""
    return rs.lower_endpoint(_bootstrap(spark, sf_dir), 3).select(F.round("lower", 6).alias("lower"), "place")


ENDPOINT_SQL = f"{BOOTSTRAP} SELECT round(max(rho), 6) AS lower, count(*) AS place FROM (SELECT rho FROM z ORDER BY rho, run LIMIT 3)"

QUERIES = {
    "doubled_midranks": doubled_midranks, "spearman_state": spearman_state, "spearman_threshold": spearman_threshold, "additive_score": additive_score, "unit_conversion": unit_conversion,
    "domain_tuple_selector": domain_tuple_selector, "paired_bootstrap": paired_bootstrap, "bootstrap_endpoint": bootstrap_endpoint,
}
ORACLE_SQL = {
    "doubled_midranks": MIDRANK_SQL, "spearman_state": SPEARMAN_SQL, "spearman_threshold": THRESHOLD_SQL, "additive_score": ADDITIVE_SQL, "unit_conversion": UNIT_SQL,
    "domain_tuple_selector": SELECTOR_SQL, "paired_bootstrap": BOOTSTRAP_SQL, "bootstrap_endpoint": ENDPOINT_SQL,
}
