"""Queries of group members that stand for others, nested closures, pairings, and masses and scores by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import selection
from seqloom.sources.tables import table


def primary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each source whose digest comes first."""
    return selection.primary_members(table(spark, sf_dir, "documents"), "source", "doc_id", "primary")


PRIMARY_SQL = "SELECT source, arg_min(doc_id, sha256('primary' || chr(0) || doc_id)) AS doc_id FROM documents GROUP BY source"


def family_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest document of each family of equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("family"))
    return selection.representatives(docs, "family", "doc_id")


REPRESENTATIVE_SQL = "SELECT sha256(text) AS family, min(doc_id) AS doc_id, count(*) AS replicas FROM documents GROUP BY 1"


def closure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by region and nation, which nest, and market segments by their customers' nations, which cross."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    whole = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    own = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    customers = table(spark, sf_dir, "customer").select(F.lit("segment"), "c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).distinct()
    rows = nation.select(F.lit("place").alias("axis"), whole.alias("group"), place.alias("member")).union(nation.select(F.lit("place"), place, place))
    rows = rows.union(region.select(F.lit("place"), own, own)).union(customers)
    return selection.closure_report(rows)


CLOSURE_SQL = """WITH m AS (SELECT DISTINCT * FROM (SELECT 'place' AS axis, 'r' || n_regionkey AS g, 'n' || n_nationkey AS x FROM nation UNION ALL SELECT 'place', 'n' || n_nationkey, 'n' || n_nationkey FROM nation
UNION ALL SELECT 'place', 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT 'segment', c_mktsegment, 'n' || c_nationkey FROM customer)),
s AS (SELECT axis, g, count(*) AS n, count(*) FILTER (g = x) AS own FROM m GROUP BY 1, 2),
p AS (SELECT a.axis, a.g AS g, b.g AS h, count(*) AS c FROM m a JOIN m b ON a.axis = b.axis AND a.x = b.x AND a.g < b.g GROUP BY 1, 2, 3),
j AS (SELECT p.axis, bool_or(c = a.n AND c = b.n) AS same, bool_or(c < least(a.n, b.n)) AS crossed FROM p JOIN s a ON a.axis = p.axis AND a.g = p.g JOIN s b ON b.axis = p.axis AND b.g = p.h GROUP BY 1),
w AS (SELECT axis, count(*) AS groups, count(*) FILTER (own = 0) AS self_missing FROM s GROUP BY 1)
SELECT axis, groups, self_missing, coalesce(same, false) AS same_members, coalesce(crossed, false) AS crossing, self_missing = 0 AND NOT coalesce(same, false) AND NOT coalesce(crossed, false) AS valid FROM w LEFT JOIN j USING (axis)"""


def pairing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against orders, which must pair off one to one: how many keys do, and how the others fail."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    found = selection.pairing(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")
    return found.groupBy("status").agg(F.count("*").alias("keys"))


PAIRING_SQL = """SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a > 1 OR b > 1 THEN 'repeated' ELSE 'paired' END AS status, count(*) AS keys
FROM (SELECT c_custkey AS k, count(*) AS a FROM customer GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders GROUP BY 1) USING (k) GROUP BY 1"""

STATES = ["A", "N", "R"]


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags as truth, with a guess that is N for large quantities and right otherwise."""
    guess = F.when(F.col("l_quantity") > 25, "N").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).cast("bigint").alias("fold"), F.col("l_returnflag").alias("truth"), guess.alias("predicted"), F.col("l_discount").cast("double").alias("mass"))


def added_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion masses of five folds, added."""
    partial = _guesses(spark, sf_dir).groupBy("fold", "truth", "predicted").agg(selection.exact_sum(F.col("mass")).alias("mass"))
    return selection.add_confusions(partial, STATES).withColumn("mass", F.round("mass", 6))


ADDED_SQL = """WITH s(x) AS (VALUES ('A'), ('N'), ('R')), d AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 25 THEN 'N' ELSE l_returnflag END AS p, CAST(l_discount AS DECIMAL(28, 8)) AS m FROM lineitem)
SELECT a.x AS truth, b.x AS predicted, round(CAST(coalesce(sum(m), 0) AS DOUBLE), 6) AS mass FROM s a CROSS JOIN s b LEFT JOIN d ON t = a.x AND p = b.x GROUP BY 1, 2"""


def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the guess less that of always saying N, by fold."""
    rows = _guesses(spark, sf_dir).groupBy("fold")
    right = lambda c: F.avg((c == F.col("truth")).cast("int")).alias("score")
    return selection.paired_folds(rows.agg(right(F.col("predicted"))), rows.agg(right(F.lit("N")))).withColumn("delta", F.round("delta", 9))


DELTAS_SQL = """SELECT fold, round(a - b, 9) AS delta, a > b AS improved FROM (SELECT CAST(l_orderkey % 5 AS BIGINT) AS fold,
avg(CAST(CASE WHEN l_quantity > 25 THEN 'N' ELSE l_returnflag END = l_returnflag AS INT)) AS a, avg(CAST(l_returnflag = 'N' AS INT)) AS b FROM lineitem GROUP BY 1)"""

QUERIES = {
    "primary_documents": primary_documents, "family_representatives": family_representatives, "closure_tables": closure_tables, "pairing_counts": pairing_counts,
    "added_confusions": added_confusions, "fold_deltas": fold_deltas,
}
ORACLE_SQL = {
    "primary_documents": PRIMARY_SQL, "family_representatives": REPRESENTATIVE_SQL, "closure_tables": CLOSURE_SQL, "pairing_counts": PAIRING_SQL,
    "added_confusions": ADDED_SQL, "fold_deltas": DELTAS_SQL,
}
