"""Metadata queries: quarantine, rights, classification, coverage, review ledgers, interval matching, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators import matching, metadata, quarantine, reviews
from seqloom.sources.tables import table

# Rules of the registered quarantine query: (rule, sources, locator prefixes, purposes).
RULES = [
    ("rule:mobile", [], ["https://m.", "http://m."], ["training"]),
    ("rule:org", [], ["http://thther.example.org"], ["training", "redistribution"]),
    ("rule:lang", ["pages-de"], [], ["training"]),
    ("rule:audit", [], ["https://"], ["redistribution"]),
]
#: (source, status, derivatives, redistribution)
REGISTRY = [("pages-en", "open_licensed", True, True), ("pages-fr", "metadata_only", True, False), ("pages-de", "public_domain", True, True), ("pages-xx", "restricted", False, False)]


def _page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as an artifact; its source is named by the language in its URL's path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    lang = F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1)
    return pages.select(F.col("page_id").cast("string").alias("artifact_id"), F.when(lang != "", F.concat(F.lit("pages-"), lang)).alias("source_id"), F.col("url").alias("locator"), F.lit(None).cast("string").alias("revision"))


def quarantine_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(REGISTRY, "source_id string, status string, derivatives boolean, redistribution boolean")
    rules = spark.createDataFrame([(r, s, p, [], u) for r, s, p, u in RULES], "rule_id string, source_ids array<string>, locator_prefixes array<string>, revisions array<string>, prohibited_purposes array<string>")
    return quarantine.inspect(_page_references(spark, sf_dir), registry, rules, "training")


_REG = "VALUES " + ", ".join(f"('{s}', '{t}', {str(d).lower()}, {str(r).lower()})" for s, t, d, r in REGISTRY)
_PRE = "VALUES " + ", ".join(f"('{r}', '{p}')" for r, _, ps, u in RULES if "training" in u for p in ps)
_SRC = "VALUES " + ", ".join(f"('{r}', '{s}')" for r, ss, _, u in RULES if "training" in u for s in ss)
QUARANTINE_SQL = f"""WITH g(source_id, status, d, r) AS ({_REG}), pre(rule_id, p) AS ({_PRE}), src(rule_id, s) AS ({_SRC}),
p AS (SELECT CAST(page_id AS VARCHAR) AS artifact_id, 'pages-' || nullif(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1), '') AS source_id, lower(trim(url)) AS l FROM pages),
a AS (SELECT artifact_id, CASE WHEN p.source_id IS NULL THEN 'source_id_missing' WHEN g.source_id IS NULL THEN 'unknown_source_id' WHEN status IN ('restricted', 'unknown') THEN 'rights_status_not_permitted'
      WHEN NOT d THEN 'derivatives_not_permitted' WHEN NOT r THEN 'redistribution_not_permitted' END AS code, p.source_id, CAST(NULL AS VARCHAR) AS rule_id FROM p LEFT JOIN g USING (source_id))
SELECT * FROM a WHERE code IS NOT NULL UNION SELECT artifact_id, 'quarantine_rule_match', source_id, rule_id FROM p JOIN pre ON starts_with(l, p) UNION SELECT artifact_id, 'quarantine_rule_match', source_id, rule_id FROM p JOIN src ON source_id = s"""


def rights_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources: what their status allows for each purpose, counted."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", "open_licensed").when(F.col("o_orderstatus") == "O", "metadata_only").otherwise("restricted")
    rows = orders.withColumn("status", status).withColumn("derivatives", F.substring("o_orderpriority", 1, 1) <= "3").withColumn("redistribution", F.substring("o_orderpriority", 1, 1) <= "1")
    found = F.array(*(F.struct(F.lit(p).alias("purpose"), F.coalesce(quarantine.rights_finding(F.col("status"), F.col("derivatives"), F.col("redistribution"), p), F.lit("permitted")).alias("outcome")) for p in ("training", "development_evaluation", "final_evaluation", "audit_only")))
    return rows.select(F.explode(found).alias("f")).groupBy("f.purpose", "f.outcome").agg(F.count("*").alias("n"))


RIGHTS_SQL = """WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'open_licensed' WHEN 'O' THEN 'metadata_only' ELSE 'restricted' END AS s, substr(o_orderpriority, 1, 1) <= '3' AS d, substr(o_orderpriority, 1, 1) <= '1' AS r FROM orders), p(purpose) AS (VALUES ('training'), ('development_evaluation'), ('final_evaluation'), ('audit_only')),
f AS (SELECT purpose, CASE WHEN purpose = 'audit_only' THEN 'permitted' WHEN s = 'restricted' THEN 'rights_status_not_permitted' WHEN purpose = 'final_evaluation' THEN 'permitted' WHEN NOT d THEN 'derivatives_not_permitted' WHEN purpose = 'training' AND NOT r THEN 'redistribution_not_permitted' ELSE 'permitted' END AS outcome FROM o, p)
SELECT purpose, outcome, count(*) AS n FROM f GROUP BY purpose, outcome"""


def candidate_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by exact tokens of their names, and a physical status by the first rule that holds."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    names = metadata.token_set(F.regexp_replace("p_name", " ", ","))
    kind = metadata.first_rule([("primary", F.array_contains(names, "ring")), ("broad", F.array_contains(metadata.token_set(F.col("p_type")), "economy"))])
    dated = F.concat(F.lit("made in "), (F.col("p_size") * 50).cast("string"))
    status = metadata.first_rule([("replica", F.arrays_overlap(names, F.array(F.lit("plate"), F.lit("cast")))), ("replica", metadata.clearly_modern(dated))], "unknown")
    return parts.select("p_partkey", kind.alias("classification"), status.alias("physical_status"))


CANDIDATE_SQL = r"""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS t, lower(p_type) AS y, p_size * 50 AS year FROM part)
SELECT p_partkey, CASE WHEN list_contains(t, 'ring') THEN 'primary' WHEN y = 'economy' THEN 'broad' END AS classification,
CASE WHEN list_has_any(t, ['plate', 'cast']) THEN 'replica' WHEN year BETWEEN 1800 AND 2100 THEN 'replica' ELSE 'unknown' END AS physical_status FROM p"""


def regex_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by three families of patterns, the evidence sorted and joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    licence, number, junk = (metadata.evidence(F.col("text"), p) for p in (r"licen[sc]e[a-z]*", r"\b[0-9]{3}-[0-9]{4}\b", r"[%$#&*]{3}"))
    rows = docs.select("doc_id", licence.alias("a"), number.alias("b"), junk.alias("c"))
    has = lambda c: F.size(c) > 0
    label = metadata.first_rule([("replica", has("a") & has("b") & has("c")), ("original", has("a") & has("b")), ("noise", has("c"))], "unresolved")
    return rows.select("doc_id", label.alias("label"), F.array_join(F.concat("a", "b", "c"), "|").alias("evidence"))


EVIDENCE_SQL = r"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
e AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(t, 'licen[sc]e[a-z]*'))) AS a, list_sort(list_distinct(regexp_extract_all(t, '\b[0-9]{3}-[0-9]{4}\b'))) AS b, list_sort(list_distinct(regexp_extract_all(t, '[%$#&*]{3}'))) AS c FROM d)
SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 AND len(c) > 0 THEN 'replica' WHEN len(a) > 0 AND len(b) > 0 THEN 'original' WHEN len(c) > 0 THEN 'noise' ELSE 'unresolved' END AS label, array_to_string(list_concat(list_concat(a, b), c), '|') AS evidence FROM e"""


def policy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files against labels as policy entries (some for documents that aren't there)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    entries = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality", "toxic")
    reasons = [("POLICY_REVIEW_INCOMPLETE", F.col("quality") == 0), ("QUARANTINED_OR_UNKNOWN_SOURCE", F.col("toxic") == 1), ("CONTENT_CONTRACT_INVALID", F.col("n_chars") < 200)]
    found = reviews.policy_coverage(docs, entries, "doc_id", reasons)
    return found.select("doc_id", "coverage", F.array_join("reasons", ",").alias("reasons"))


COVERAGE_SQL = """WITH e AS (SELECT doc_id * 2 AS doc_id, quality, toxic, true AS entry FROM labels), d AS (SELECT doc_id, n_chars, true AS file FROM documents)
SELECT doc_id, CASE WHEN entry IS NULL THEN 'uncovered' WHEN file IS NULL THEN 'extra' ELSE 'covered' END AS coverage,
CASE WHEN entry IS NULL OR file IS NULL THEN 'RIGHTS_COVERAGE_INCOMPLETE' ELSE array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'CONTENT_CONTRACT_INVALID' END, CASE WHEN quality = 0 THEN 'POLICY_REVIEW_INCOMPLETE' END, CASE WHEN toxic = 1 THEN 'QUARANTINED_OR_UNKNOWN_SOURCE' END], lambda x: x IS NOT NULL), ',') END AS reasons
FROM d FULL JOIN e USING (doc_id)"""


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as reviews of their user: some supersede the user's event before, purchases are decisions."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = events.withColumn("supersedes", F.when(F.col("event_id") % 5 == 0, before).when(F.col("event_id") % 97 == 3, F.col("event_id") - 3).when(F.col("event_id") % 211 == 7, F.lit(-1)))
    rows = marked.select(F.col("event_id").alias("review_id"), F.col("ts").alias("at"), F.col("user_id").alias("subject_id"), "supersedes", (F.col("value") >= 5.0).alias("complete"), "event_type")
    decisions = events.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("decision_id"), F.col("ts").alias("at"), F.col("user_id").alias("subject_id"))
    return rows, decisions


def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.supersession_edges(_reviews(spark, sf_dir)[0], ["subject_id"])


REVIEWS = """rv AS (SELECT event_id AS review_id, ts AS at, user_id AS subject_id, event_type, value >= 5.0 AS complete,
CASE WHEN event_id % 5 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN event_id % 97 = 3 THEN event_id - 3 WHEN event_id % 211 = 7 THEN -1 END AS supersedes FROM events),
eg AS (SELECT a.review_id, a.supersedes AS target, CASE WHEN b.review_id IS NULL THEN 'unknown_review' WHEN count(*) OVER (PARTITION BY a.supersedes) > 1 THEN 'multiple_successors' WHEN a.subject_id <> b.subject_id THEN 'protected_field_changed' WHEN a.at <= b.at THEN 'not_later' END AS problem
FROM rv a LEFT JOIN rv b ON b.review_id = a.supersedes WHERE a.supersedes IS NOT NULL)"""
CHAIN_SQL = f"WITH {REVIEWS} SELECT review_id, target, problem FROM eg"


def asof_eligible_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, decisions = _reviews(spark, sf_dir)
    return reviews.eligible_as_of(rows, reviews.supersession_edges(rows, ["subject_id"]), decisions, "subject_id").select("decision_id", F.col("eligible").cast("bigint").alias("eligible"))


ASOF_SQL = f"""WITH {REVIEWS}, ok AS (SELECT target, review_id FROM eg WHERE problem IS NULL), iv AS (SELECT rv.subject_id, rv.at AS s, n.at AS e FROM rv LEFT JOIN ok ON ok.target = rv.review_id LEFT JOIN rv n ON n.review_id = ok.review_id WHERE rv.complete)
SELECT d.review_id AS decision_id, (SELECT count(*) FROM iv WHERE iv.subject_id = d.subject_id AND s <= d.at AND (e IS NULL OR e > d.at)) AS eligible FROM rv d WHERE d.event_type = 'purchase'"""


def reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule that reads the text, as two reviewers of the same documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("l_quality"), F.col("toxic").alias("l_toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (~F.col("text").rlike(r"[%$#&*]{3}|!!| \| ")).cast("int").alias("r_quality"), F.lower("text").rlike(r"\b(idiot|moron|scum|loser)\b").cast("int").alias("r_toxic"))
    found = reviews.agreement(labels.join(docs, "doc_id"), ["quality", "toxic"])
    return found.select("pairs", F.round("quality_agreement", 6).alias("quality_agreement"), F.round("toxic_agreement", 6).alias("toxic_agreement"))


AGREEMENT_SQL = r"""WITH d AS (SELECT doc_id, CAST(NOT regexp_matches(text, '[%$#&*]{3}|!!| \| ') AS INTEGER) AS q, CAST(regexp_matches(lower(text), '\b(idiot|moron|scum|loser)\b') AS INTEGER) AS t FROM documents)
SELECT count(*) AS pairs, round(avg(CASE WHEN quality = q THEN 1.0::DOUBLE ELSE 0 END), 6) AS quality_agreement, round(avg(CASE WHEN toxic = t THEN 1.0::DOUBLE ELSE 0 END), 6) AS toxic_agreement FROM labels JOIN d USING (doc_id)"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as predicted anchors and views as reference intervals, in lanes by user and day."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    second = F.unix_timestamp("ts") % 86400
    rows = events.withColumn("page", F.date_format("ts", "yyyy-MM-dd")).withColumn("lane", F.col("user_id") % 20).withColumn("y", second)
    points = rows.filter("event_type = 'click'").select("page", "lane", F.col("event_id").alias("prediction_id"), F.col("y").alias("anchor"))
    spans = rows.filter("event_type = 'view'").select("page", "lane", F.col("event_id").alias("reference_id"), F.col("y").alias("y0"), (F.col("y") + F.greatest(F.floor(F.col("value") * 60), F.lit(1))).alias("y1"))
    return points, spans


def interval_label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, spans = _lanes(spark, sf_dir)
    return matching.interval_candidates(points, spans, ["page", "lane"], 1800).select("prediction_id", "reference_id")


INTERVAL_SQL = """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS page, user_id % 20 AS lane, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS y, event_type, value FROM events)
SELECT a.event_id AS prediction_id, b.event_id AS reference_id FROM e a JOIN e b ON a.page = b.page AND a.lane = b.lane AND a.y >= b.y AND a.y < b.y + greatest(CAST(floor(b.value * 60) AS BIGINT), 1) WHERE a.event_type = 'click' AND b.event_type = 'view'"""


def interval_lane_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest ordered matching of each lane, and whether it is the only one."""
    points, spans = _lanes(spark, sf_dir)
    return matching.lane_scores(points, spans, ["page", "lane"])


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal content, and how large they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_token"), "n_chars")
    return docs.groupBy("content_token").agg(F.count("*").alias("files"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("n_chars")).filter("files > 1")


DUPLICATES_SQL = "SELECT sha256(text) AS content_token, count(*) AS files, min(doc_id) AS first_id, max(n_chars) AS n_chars FROM documents GROUP BY text HAVING count(*) > 1"


def duplicate_id_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose part was on the order already, with the line that had it first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate")
    own = W.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_shipdate")
    marked = lines.withColumn("n", F.row_number().over(own)).withColumn("first_line", F.first("l_linenumber").over(own))
    return marked.filter("n > 1").select("l_orderkey", "l_partkey", "l_linenumber", "first_line", F.lit("duplicate_token_id").alias("code"), F.lit("error").alias("severity"))


DUPLICATE_SQL = """SELECT l_orderkey, l_partkey, l_linenumber, first_line, 'duplicate_token_id' AS code, 'error' AS severity FROM (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER w AS n, first_value(l_linenumber) OVER w AS first_line
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_shipdate)) WHERE n > 1"""


def permutation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers aren't exactly 1 to n."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linenumber").alias("kinds"), F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))
    return lines.filter("kinds <> n OR low <> 1 OR high <> n").select("l_orderkey", "n", F.lit("noncontiguous_visual_order").alias("code"))


PERMUTATION_SQL = "SELECT l_orderkey, count(*) AS n, 'noncontiguous_visual_order' AS code FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) <> count(*) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)"


def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, benchmark ids and orders of customers that point at nothing, counted by kind."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    orders, customers = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey")
    a = labels.join(docs, "doc_id", "left_anti").select(F.lit("unknown_image_reference").alias("code"), F.col("doc_id").alias("value"))
    b = orders.join(customers, "c_custkey", "left_anti").select(F.lit("unknown_source_record_reference").alias("code"), F.col("c_custkey").alias("value"))
    return a.unionByName(b).groupBy("code", "value").agg(F.count("*").alias("n"))


INTEGRITY_SQL = """WITH a AS (SELECT doc_id * 3 AS v FROM labels), b AS (SELECT o_custkey + 7 AS v FROM orders)
SELECT 'unknown_image_reference' AS code, v AS value, count(*) AS n FROM a WHERE v NOT IN (SELECT doc_id FROM documents) GROUP BY v
UNION ALL SELECT 'unknown_source_record_reference', v, count(*) FROM b WHERE v NOT IN (SELECT c_custkey FROM customer) GROUP BY v"""


def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a corpus: kinds by how they are written, with conditional sums."""
    docs = table(spark, sf_dir, "documents").select("text", "n_chars")
    kind = metadata.first_rule([("table", F.col("text").contains(" | ")), ("noise", F.col("text").rlike(r"[%$#&*]{3}")), ("lines", F.col("text").contains("\n"))], "line")
    return docs.groupBy(kind.alias("format")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("characters"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"))


FORMAT_SQL = """SELECT CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[%$#&*]{3}') THEN 'noise' WHEN contains(text, chr(10)) THEN 'lines' ELSE 'line' END AS format, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS characters,
count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (regexp_matches(text, '[0-9]')) AS with_digits FROM documents GROUP BY 1"""


def partition_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the parts of a split by conversation are disjoint and cover all turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    parts = turns.withColumn("part", F.col("conv_id") % 3)
    each = parts.groupBy("conv_id").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("turns"))
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("parts") != 1).alias("torn"), F.sum("turns").alias("turns"))


COVER_SQL = "WITH e AS (SELECT conv_id, count(DISTINCT conv_id % 3) AS p, count(*) AS t FROM conversations GROUP BY conv_id) SELECT count(*) AS groups, count(*) FILTER (p <> 1) AS torn, CAST(sum(t) AS BIGINT) AS turns FROM e"

QUERIES = {
    "quarantine_findings": quarantine_findings, "rights_gate": rights_gate, "candidate_classification": candidate_classification, "regex_evidence": regex_evidence, "policy_coverage": policy_coverage,
    "supersession_chain": supersession_chain, "asof_eligible_reviews": asof_eligible_reviews, "reviewer_agreement": reviewer_agreement, "interval_label_candidates": interval_label_candidates,
    "interval_lane_scores": interval_lane_scores, "content_duplicates": content_duplicates, "duplicate_id_issues": duplicate_id_issues, "permutation_check": permutation_check,
    "reference_integrity": reference_integrity, "format_summary": format_summary, "partition_cover": partition_cover,
}
ORACLE_SQL = {
    "quarantine_findings": QUARANTINE_SQL, "rights_gate": RIGHTS_SQL, "candidate_classification": CANDIDATE_SQL, "regex_evidence": EVIDENCE_SQL, "policy_coverage": COVERAGE_SQL,
    "supersession_chain": CHAIN_SQL, "asof_eligible_reviews": ASOF_SQL, "reviewer_agreement": AGREEMENT_SQL, "interval_label_candidates": INTERVAL_SQL, "content_duplicates": DUPLICATES_SQL,
    "duplicate_id_issues": DUPLICATE_SQL, "permutation_check": PERMUTATION_SQL, "reference_integrity": INTEGRITY_SQL, "format_summary": FORMAT_SQL, "partition_cover": COVER_SQL,
}
