"""Smaller queries: keys, aliases, context axes, exclusions, ladders, digests, line rebuilding, tokens to grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import family_key, group_text, image_hash
from seqloom.operators import commitments, graph, metadata, population, sequences
from seqloom.sources.tables import table


def opaque_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and line keys that tell nothing: domain-separated digests of id and (key, index)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    key = F.sha2(F.concat(F.lit("document\0"), F.col("doc_id").cast("string")), 256)
    return docs.select("doc_id", F.col("k").cast("bigint").alias("line_index"), F.sha2(F.concat(F.lit("token\0"), key, F.lit("\0"), F.col("k").cast("string")), 256).alias("token_key"))


OPAQUE_SQL = """WITH d AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)
SELECT doc_id, k AS line_index, sha256('token' || chr(0) || sha256('document' || chr(0) || doc_id) || chr(0) || k) AS token_key FROM d"""


def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of pages as sources write them, brought to one form and matched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    digest = F.sha2("html", 256)
    written = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("SHA256:"), F.upper(digest))).when(F.col("page_id") % 3 == 1, F.concat(F.lit(" sha-256: "), digest)).otherwise(F.lit(" "))
    return pages.select("page_id", image_hash(written).alias("image_hash"))


HASH_SQL = "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN sha256(html) END AS image_hash FROM pages"


def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue aliases of parts that are complete, with how many parts share each."""
    parts = table(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"))
    full = parts.filter((F.trim("p_brand") != "") & F.col("p_type").isNotNull())
    return full.groupBy(F.col("p_brand").alias("catalog"), F.col("p_type").alias("identifier")).agg(F.count("*").alias("artifacts"))


ALIAS_SQL = "SELECT p_brand AS catalog, p_type AS identifier, count(*) AS artifacts FROM part WHERE p_size > 25 GROUP BY p_brand, p_type"


def family_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family or lone-artifact key and group text of each customer."""
    c = table(spark, sf_dir, "customer")
    family = F.when(F.col("c_nationkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", family_key(family, F.col("c_name")).alias("family"), group_text(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("group_value"))


FAMILY_SQL = """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'artifact:' || c_name ELSE 'family:' || c_nationkey END AS family, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '<missing>' END AS group_value FROM customer"""


def context_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which context axes each order has evidence for, and from which fields."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"), F.lit(" ").alias("blank"))
    found = metadata.axes({"state": ["status", "blank"], "urgency": ["priority"], "both": ["status", "priority"]})
    return orders.select("o_orderkey", F.explode(found).alias("a")).select("o_orderkey", "a.axis", F.array_join("a.fields", ",").alias("fields"))


AXES_SQL = """WITH o AS (SELECT o_orderkey, o_orderstatus <> 'F' AS s, o_totalprice > 100000 AS p FROM orders)
SELECT o_orderkey, 'state' AS axis, 'status' AS fields FROM o WHERE s UNION ALL SELECT o_orderkey, 'urgency', 'priority' FROM o WHERE p
UNION ALL SELECT o_orderkey, 'both', CASE WHEN s AND p THEN 'status,priority' WHEN s THEN 'status' ELSE 'priority' END FROM o WHERE s OR p"""


def component_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as components of their orders: the first reason to leave each out, and contexts of all and of eligible orders."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("component"), (F.col("o_totalprice") > 400000).alias("prior_exposure"), (F.col("o_orderstatus") == "P").alias("conflict"), F.col("o_orderpriority").startswith("1").alias("dependence"),
        F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("ok"),
    )
    contexts = population.component_contexts(orders, ["priority"], "ok")
    found = population.exclusion_reasons(orders).join(contexts, "component")
    return found.select("component", "reason", F.array_join("priority", "|").alias("contexts"), F.array_join("priority_trigger", "|").alias("trigger_contexts"))


EXCLUSION_SQL = """SELECT o_custkey AS component, CASE WHEN bool_or(o_totalprice > 400000) THEN 'prior_exposure' WHEN bool_or(o_orderstatus = 'P') THEN 'conflict' WHEN bool_or(starts_with(o_orderpriority, '1')) THEN 'dependence' END AS reason,
array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS contexts, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')), '|'), '') AS trigger_contexts FROM orders GROUP BY o_custkey"""


def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each order fails, counted."""
    orders = table(spark, sf_dir, "orders")
    state = population.first_failure([("status_missing", F.when(F.col("o_orderkey") % 11 != 0, True)), ("status_open", F.col("o_orderstatus") != "O"), ("price_low", F.col("o_totalprice") >= 150000)], "ready")
    return orders.groupBy(state.alias("state")).agg(F.count("*").alias("orders"))


STATES_SQL = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'status_missing' WHEN o_orderstatus = 'O' THEN 'status_open' WHEN o_totalprice < 150000 THEN 'price_low' ELSE 'ready' END AS state, count(*) AS orders FROM orders GROUP BY 1"


def rebuilt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in runs of equal types, and runs whose type comes back."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit"), "event_id", "ts", F.when(F.col("value") >= 5.0, F.col("event_type")).alias("key"))
    lines = sequences.regroup_lines(sequences.positions(events, ["unit"], ["ts", "event_id"]), ["unit"], "key")
    return lines.select("event_id", F.col("line_ordinal").cast("bigint").alias("line_ordinal"), "returned")


REBUILT_SQL = """WITH e AS (SELECT user_id AS u, event_id, CASE WHEN value >= 5.0 THEN event_type END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
n AS (SELECT *, CASE WHEN k IS NOT NULL AND k = lag(k) OVER (PARTITION BY u ORDER BY p) THEN 0 ELSE 1 END AS b FROM e), l AS (SELECT *, CAST(sum(b) OVER (PARTITION BY u ORDER BY p) AS BIGINT) AS line_ordinal FROM n)
SELECT event_id, line_ordinal, k IS NOT NULL AND max(line_ordinal) OVER (PARTITION BY u, k) > min(line_ordinal) OVER (PARTITION BY u, k) AS returned FROM l"""


def documents_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free commitment to all documents."""
    docs = table(spark, sf_dir, "documents")
    return commitments.order_free_digest(docs, F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("\0"), F.col("text")), 256))


DOCUMENTS_SQL = """SELECT sha256(string_agg(part, '' ORDER BY p)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT substr(d, 1, 3) AS p, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS part FROM (SELECT sha256(doc_id || chr(0) || text) AS d FROM documents) GROUP BY 1)"""


def pointer_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that point at one another: which lie on a cycle."""
    n = table(spark, sf_dir, "supplier").count()
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 17 != 5, (F.col("s_suppkey") * 7 + 3) % n).alias("next"))
    return graph.chain_cycles(rows)


CYCLES_SQL = """WITH RECURSIVE s AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 17 <> 5 THEN (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) END AS nxt FROM supplier),
w(start, spot) AS (SELECT node, nxt FROM s WHERE nxt IS NOT NULL UNION SELECT start, nxt FROM w JOIN s ON s.node = w.spot WHERE nxt IS NOT NULL)
SELECT node, node IN (SELECT start FROM w WHERE start = spot) AS in_cycle FROM s"""

QUERIES = {
    "opaque_ids": opaque_ids, "image_hashes": image_hashes, "alias_pairs": alias_pairs, "family_keys": family_keys, "context_axes": context_axes, "component_exclusions": component_exclusions,
    "terminal_states": terminal_states, "rebuilt_lines": rebuilt_lines, "documents_digest": documents_digest, "pointer_cycles": pointer_cycles,
}
ORACLE_SQL = {
    "opaque_ids": OPAQUE_SQL, "image_hashes": HASH_SQL, "alias_pairs": ALIAS_SQL, "family_keys": FAMILY_SQL, "context_axes": AXES_SQL, "component_exclusions": EXCLUSION_SQL, "terminal_states": STATES_SQL,
    "rebuilt_lines": REBUILT_SQL, "documents_digest": DOCUMENTS_SQL, "pointer_cycles": CYCLES_SQL,
}
