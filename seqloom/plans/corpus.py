"""Sequence-corpus queries: reading order, manifests, leakage, splits, n-gram baselines, null models, graphs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.hashing import keyed_digest
from seqloom.operators import language_models as lm
from seqloom.operators import commitments, leakage, nulls, sequences, splits
from seqloom.operators.graph import adjacency, treewidth_bounds
from seqloom.operators.ranking import holdout_size
from seqloom.operators.shuffled_graphs import shuffled_adjacency
from seqloom.runtime import Scratch
from seqloom.sources.tables import document_lines, event_lines, event_tokens, table

SEGMENT = ["artifact_id", "seg"]
#: Sizes of the registered null models; each is an argument too.
RUNS = 20
WIDTH_RUNS = 100
#: Tokens of all runs of the treewidth null model that lie on disk at once, as a few bytes each.
WIDTH_ROWS = 300_000_000

# ---- SQL shared by the oracles -------------------------------------------------------------------------------------

EV = """
ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS artifact_id, 'family:' || user_id AS family, 's' || (user_id % 5) AS site,
              CASE WHEN value >= 5.0 THEN event_type END AS sign, event_type AS truth,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
cut AS (SELECT *, CAST(sum(CASE WHEN sign IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY pos) AS BIGINT) AS seg FROM ev),
tok AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, seg ORDER BY pos) AS idx FROM cut WHERE sign IS NOT NULL)
"""
SPLIT = """
fam AS (SELECT DISTINCT family FROM ev),
ranked AS (SELECT family, row_number() OVER (ORDER BY sha256('0' || chr(0) || family), family) AS r, count(*) OVER () AS n FROM fam),
part AS (SELECT family, CASE WHEN r <= least(n - 1, greatest(1, floor(n * 0.2 + 0.5))) THEN 'test' ELSE 'train' END AS partition FROM ranked)
"""
DOC = r"""
dl AS (SELECT doc_id, lang, source, sha256(text) AS text_hash, line_no - 1 AS line_no, trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g'), ' ') AS line
       FROM (SELECT doc_id, lang, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)),
docline AS (SELECT * FROM dl WHERE line <> '')
"""

# ---- reading order, gaps, fingerprints -------------------------------------------------------------------------------


def unnest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to lines to tokens, counted by document."""
    lines = document_lines(spark, sf_dir)
    tokens = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("visual_index", "token"))
    return tokens.groupBy("doc_id").agg(F.count_distinct("line_no").alias("lines"), F.count("*").alias("tokens"), F.max("visual_index").cast("bigint").alias("last_index"))


UNNEST_SQL = f"""WITH {DOC}, t AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) - 1 AS visual_index FROM docline)
SELECT doc_id, count(DISTINCT line_no) AS lines, count(*) AS tokens, max(visual_index) AS last_index FROM t GROUP BY doc_id"""


def reading_order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of readable signs of each artifact, as joined text."""
    tokens = sequences.segments(event_tokens(spark, sf_dir), ["artifact_id"])
    return tokens.groupBy(*SEGMENT).agg(F.count("*").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sign"))), lambda t: t["sign"]), " ").alias("signs"))


SEGMENTS_SQL = f"WITH {EV} SELECT artifact_id, seg, count(*) AS length, string_agg(sign, ' ' ORDER BY idx) AS signs FROM tok GROUP BY artifact_id, seg"


def line_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each readable day line, unreadable signs filled in."""
    lines = event_lines(spark, sf_dir).groupBy("artifact_id", "day").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sign"))), lambda t: t["sign"]).alias("slots"))
    found = lines.select("artifact_id", "day", sequences.fingerprint(F.col("slots")).alias("signs")).filter("signs IS NOT NULL")
    return found.select("artifact_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("signs").cast("bigint").alias("length"), F.sha2(F.array_join("signs", " "), 256).alias("fingerprint"))


FINGERPRINT_SQL = f"""WITH {EV} SELECT artifact_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS length, sha256(string_agg(coalesce(sign, '<unreadable>'), ' ' ORDER BY ts, event_id)) AS fingerprint
FROM ev GROUP BY artifact_id, strftime(ts, '%Y-%m-%d') HAVING count(sign) > 0"""


def length_policy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a least length of three signs changes the segments."""
    runs = sequences.segments(event_tokens(spark, sf_dir), ["artifact_id"]).groupBy(*SEGMENT).agg(F.collect_list("sign").alias("signs"))
    return sequences.length_policy(runs, "signs", 3)[1]


LENGTH_SQL = f"""WITH {EV}, s AS (SELECT count(*) AS n FROM tok GROUP BY artifact_id, seg)
SELECT count(*) AS sequences_before, CAST(coalesce(sum(n), 0) AS BIGINT) AS tokens_before, count(*) FILTER (n < 3) AS sequences_excluded,
CAST(coalesce(sum(n) FILTER (n < 3), 0) AS BIGINT) AS tokens_excluded, count(*) FILTER (n >= 3) AS sequences_after, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS tokens_after FROM s"""

# ---- manifest --------------------------------------------------------------------------------------------------------


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts and characters over all documents and by source, language and both, in one pass."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    docs.createOrReplaceTempView("manifest_documents")
    return spark.sql(
        "SELECT coalesce(source, '<all>') AS site, coalesce(lang, '<all>') AS object_type, count(*) AS artifacts, sum(n_chars) AS characters "
        "FROM manifest_documents GROUP BY GROUPING SETS ((source), (lang), (source, lang), ())"
    )


MANIFEST_SQL = """SELECT coalesce(source, '<all>') AS site, coalesce(lang, '<all>') AS object_type, count(*) AS artifacts, CAST(sum(n_chars) AS BIGINT) AS characters
FROM documents GROUP BY GROUPING SETS ((source), (lang), (source, lang), ())"""

# ---- leakage and splits ----------------------------------------------------------------------------------------------


def _document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    family = lines.select(F.col("doc_id").alias("artifact"), F.lit("family").alias("kind"), F.col("text_hash").alias("value")).distinct()
    sequence = lines.select(F.col("doc_id").alias("artifact"), F.lit("sequence").alias("kind"), F.sha2("line", 256).alias("value"))
    return family.unionByName(sequence)


def _with_row_split(evidence: DataFrame) -> DataFrame:
    """A split by row digest that ignores families, so that leakage is there to be found."""
    return evidence.withColumn("partition", F.when(F.substring(keyed_digest(0, F.col("artifact")), 1, 1).isin("0", "1", "2"), "test").otherwise("train"))


def leakage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.overlaps(_with_row_split(_document_evidence(spark, sf_dir)))
    return found.select("kind", "value", "partition", F.col("artifact").alias("doc_id"))


EVIDENCE = """
evi AS (SELECT DISTINCT doc_id AS artifact, 'family' AS kind, text_hash AS value FROM docline UNION SELECT DISTINCT doc_id, 'sequence', sha256(line) FROM docline),
sided AS (SELECT *, CASE WHEN substr(sha256('0' || chr(0) || artifact), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS partition FROM evi)
"""
OVERLAP_SQL = f"""WITH {DOC}, {EVIDENCE}, two_sided AS (SELECT kind, value FROM sided GROUP BY kind, value HAVING count(*) FILTER (partition = 'train') > 0 AND count(*) FILTER (partition = 'test') > 0)
SELECT kind, value, partition, artifact AS doc_id FROM sided JOIN two_sided USING (kind, value)"""


def unseen_test_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of test documents that no train document holds, word for word."""
    lines = _with_row_split(document_lines(spark, sf_dir).withColumn("artifact", F.col("doc_id")))
    found = leakage.unseen(lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", "partition"), "line")
    return found.select("doc_id", "line_no", F.sha2("line", 256).alias("sequence"))


UNSEEN_SQL = f"""WITH {DOC}, sided AS (SELECT *, CASE WHEN substr(sha256('0' || chr(0) || doc_id), 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS partition FROM docline)
SELECT doc_id, line_no, sha256(line) AS sequence FROM sided t WHERE partition = 'test' AND NOT EXISTS (SELECT 1 FROM sided x WHERE x.partition = 'train' AND x.line = t.line)"""


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.report(_with_row_split(_document_evidence(spark, sf_dir)))


REPORT_SQL = f"""WITH {DOC}, {EVIDENCE}, s AS (SELECT kind, value, count(*) FILTER (partition = 'train') AS a, count(*) FILTER (partition = 'test') AS b FROM sided GROUP BY kind, value)
SELECT kind, count(*) AS findings, CAST(sum(a) AS BIGINT) AS train_links, CAST(sum(b) AS BIGINT) AS test_links FROM s WHERE a > 0 AND b > 0 GROUP BY kind"""


def leakage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by equal texts or lines; the component is its smallest document."""
    found = splits.leakage_components(_document_evidence(spark, sf_dir))
    return found.select(F.col("artifact").alias("doc_id"), F.col("component").alias("component_id"))


COMPONENTS = """
link AS (SELECT a.artifact AS u, b.c AS v FROM evi a JOIN (SELECT kind, value, min(artifact) AS c FROM evi GROUP BY kind, value HAVING count(*) > 1) b USING (kind, value)),
both_ways AS (SELECT u, v FROM link WHERE u <> v UNION SELECT v, u FROM link WHERE u <> v),
reach(node, top) AS (SELECT DISTINCT artifact, artifact FROM evi UNION SELECT w.v, r.top FROM reach r JOIN both_ways w ON w.u = r.node WHERE r.top < w.v),
comp AS (SELECT node AS doc_id, min(top) AS component_id FROM reach GROUP BY node)
"""
COMPONENTS_SQL = f"WITH RECURSIVE {DOC}, {EVIDENCE}, {COMPONENTS} SELECT doc_id, component_id FROM comp"


def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = event_tokens(spark, sf_dir).groupBy("artifact_id", "family").agg(F.count("*").alias("tokens"))
    return splits.group_split(tokens, "family").select("artifact_id", "tokens", "partition")


FAMILY_SQL = f"WITH {EV}, {SPLIT} SELECT artifact_id, count(*) AS tokens, partition FROM ev JOIN part USING (family) GROUP BY artifact_id, partition"


def leakage_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole leakage components go to one side, ranked by the digest of their members."""
    scratch = Scratch(spark, "safe-split")
    components = scratch.keep(splits.leakage_components(_document_evidence(spark, sf_dir), scratch), "components")
    keyed = scratch.keep(splits.component_keys(components), "keys")
    done = splits.group_split(keyed, "component_key")
    return done.select(F.col("artifact").alias("doc_id"), F.col("component").alias("component_id"), "partition")


SAFE_SQL = f"""WITH RECURSIVE {DOC}, {EVIDENCE}, {COMPONENTS},
keyed AS (SELECT component_id, sha256(string_agg(sha256(CAST(doc_id AS VARCHAR)), ',' ORDER BY sha256(CAST(doc_id AS VARCHAR)))) AS k FROM comp GROUP BY component_id),
r AS (SELECT component_id, row_number() OVER (ORDER BY sha256('0' || chr(0) || k), k) AS r, count(*) OVER () AS n FROM keyed)
SELECT doc_id, component_id, CASE WHEN r <= least(n - 1, greatest(1, floor(n * 0.2 + 0.5))) THEN 'test' ELSE 'train' END AS partition FROM comp JOIN r USING (component_id)"""


def leave_one_site_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source: documents held out with their whole families, counted."""
    docs = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("family"))
    return splits.leave_one_out_counts(docs, "source", "family")


def leave_one_object_type_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("family"))
    return splits.leave_one_out_counts(docs, "lang", "family")


def leave_one_period_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each month: events held out with all events of their users."""
    events = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "user_id")
    return splits.leave_one_out_counts(events, "month", "user_id")


def _leave_sql(source: str, group: str, family: str) -> str:
    return f"""WITH r AS (SELECT {group} AS g, {family} AS f FROM {source}), s AS (SELECT f, count(*) AS n FROM r GROUP BY f), h AS (SELECT DISTINCT g, f FROM r)
SELECT g AS held_out, CAST(sum(n) AS BIGINT) AS test_rows, count(*) AS test_families, (SELECT count(*) FROM r) - CAST(sum(n) AS BIGINT) AS train_rows FROM h JOIN s USING (f) GROUP BY g"""


# ---- n-gram baselines --------------------------------------------------------------------------------------------------


def _split_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = splits.group_split(event_tokens(spark, sf_dir), "family")
    cut = sequences.segments(tokens, ["artifact_id"])
    return cut.filter("partition = 'train'"), cut.filter("partition = 'test'")


def unigram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split_tokens(spark, sf_dir)
    return lm.unigram(train).select("sign", "n", F.round("probability", 6).alias("probability"))


UNIGRAM_SQL = f"""WITH {EV}, {SPLIT}, tr AS (SELECT tok.* FROM tok JOIN part USING (family) WHERE partition = 'train')
SELECT sign, count(*) AS n, round(count(*) / (SELECT count(*) FROM tr)::DOUBLE, 6) AS probability FROM tr GROUP BY sign"""


def unigram_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split_tokens(spark, sf_dir)
    scored = test.join(lm.unigram(train), "sign", "left").withColumn("p", F.coalesce("probability", F.lit(0.0)))
    return _rounded(lm.heldout_score(scored))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes))


UNIGRAM_HELDOUT_SQL = f"""WITH {EV}, {SPLIT}, t AS (SELECT tok.*, partition FROM tok JOIN part USING (family)),
m AS (SELECT sign, count(*) / (SELECT count(*) FROM t WHERE partition = 'train')::DOUBLE AS p FROM t WHERE partition = 'train' GROUP BY sign),
s AS (SELECT ln(p) AS l FROM t LEFT JOIN m USING (sign) WHERE partition = 'test')
SELECT count(*) AS token_count, round(sum(l), 6) AS log_likelihood, round(-sum(l) / count(*), 6) AS mean_nll, round(exp(-sum(l) / count(*)), 6) AS perplexity FROM s"""


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram counts over all segments."""
    tokens = lm.contexts(sequences.segments(event_tokens(spark, sf_dir), ["artifact_id"]), SEGMENT, 3)
    return tokens.groupBy(F.array_join("ctx", " ").alias("context"), "sign").agg(F.count("*").alias("n"))


NGRAM_SQL = f"""WITH {EV}, c AS (SELECT sign, coalesce(lag(sign, 2) OVER s, chr(0) || '<BOS>') || ' ' || coalesce(lag(sign, 1) OVER s, chr(0) || '<BOS>') AS context
FROM tok WINDOW s AS (PARTITION BY artifact_id, seg ORDER BY idx)) SELECT context, sign, count(*) AS n FROM c GROUP BY context, sign"""


def bigram_heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out perplexity of the add-one bigram model on a family split."""
    train, test = _split_tokens(spark, sf_dir)
    fitted = lm.add_one(lm.contexts(train, SEGMENT, 2))
    known = lm.contexts(lm.known_signs(test, fitted[0]), SEGMENT, 2)
    return _rounded(lm.heldout_score(lm.token_probabilities(known, fitted)))


BIGRAM = f"""WITH {EV}, {SPLIT}, t AS (SELECT tok.*, partition FROM tok JOIN part USING (family)),
c AS (SELECT *, coalesce(lag(sign) OVER (PARTITION BY artifact_id, seg ORDER BY idx), chr(0) || '<BOS>') AS ctx FROM t),
g AS (SELECT ctx, sign, count(*) AS n FROM c WHERE partition = 'train' GROUP BY ctx, sign), x AS (SELECT ctx, sum(n) AS n_ctx FROM g GROUP BY ctx),
v AS (SELECT count(DISTINCT sign) AS v FROM g)"""
BIGRAM_SQL = f"""{BIGRAM}, s AS (SELECT ln((coalesce(n, 0) + 1) / (coalesce(n_ctx, 0) + v + 1)::DOUBLE) AS l FROM c LEFT JOIN g USING (ctx, sign) LEFT JOIN x USING (ctx), v WHERE partition = 'test')
SELECT count(*) AS token_count, round(sum(l), 6) AS log_likelihood, round(-sum(l) / count(*), 6) AS mean_nll, round(exp(-sum(l) / count(*)), 6) AS perplexity FROM s"""


def masked_sign_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split_tokens(spark, sf_dir)
    ranks = lm.masked_ranks(test, lm.add_one(lm.contexts(train, SEGMENT, 2)), SEGMENT)
    return _rounded(lm.masked_score(ranks))


MASKED_SQL = f"""{BIGRAM}, te AS (SELECT sign, ctx AS l, lead(sign) OVER (PARTITION BY artifact_id, seg ORDER BY idx) AS r FROM c WHERE partition = 'test'),
pr AS (SELECT DISTINCT l, r FROM te), w AS (SELECT DISTINCT sign AS y FROM g),
sc AS (SELECT l, r, y, ln((coalesce(g1.n, 0) + 1) / (coalesce(x1.n_ctx, 0) + v + 1)::DOUBLE) + CASE WHEN r IS NULL THEN 0 ELSE ln((coalesce(g2.n, 0) + 1) / (coalesce(x2.n_ctx, 0) + v + 1)::DOUBLE) END AS s
       FROM pr CROSS JOIN w CROSS JOIN v LEFT JOIN g g1 ON g1.ctx = l AND g1.sign = y LEFT JOIN x x1 ON x1.ctx = l LEFT JOIN g g2 ON g2.ctx = y AND g2.sign = r LEFT JOIN x x2 ON x2.ctx = y),
rk AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY l, r) AS p, row_number() OVER (PARTITION BY l, r ORDER BY round(s, 12) DESC, y) AS rank FROM sc),
f AS (SELECT p, rank FROM te JOIN rk ON te.l = rk.l AND te.r IS NOT DISTINCT FROM rk.r AND te.sign = rk.y)
SELECT count(*) AS evaluated, count(*) FILTER (rank = 1) AS top1, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(ln(p)), 6) AS mean_log_probability, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM f"""

# ---- null models -------------------------------------------------------------------------------------------------------


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.segments(event_tokens(spark, sf_dir), ["artifact_id"]).select("artifact_id", "seg", "idx", "event_id", "family", "sign")


def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One global permutation of signs over all readable places."""
    tokens = nulls.with_runs(_segmented(spark, sf_dir), 1)
    return nulls.shuffle_signs(tokens, "event_id", ["run"]).select("event_id", "sign")


GLOBAL_SQL = f"""WITH {EV}, a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM tok), b AS (SELECT sign, row_number() OVER (ORDER BY sha256('0|' || event_id), event_id) AS n FROM tok)
SELECT event_id, sign FROM a JOIN b USING (n)"""


def within_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = nulls.with_runs(_segmented(spark, sf_dir), 1)
    return nulls.shuffle_within(tokens, "event_id", SEGMENT).select("event_id", "sign")


WITHIN_SQL = f"""WITH {EV}, a AS (SELECT artifact_id, seg, event_id, row_number() OVER (PARTITION BY artifact_id, seg ORDER BY event_id) AS n FROM tok),
b AS (SELECT artifact_id, seg, sign, row_number() OVER (PARTITION BY artifact_id, seg ORDER BY sha256('0|' || event_id), event_id) AS n FROM tok)
SELECT event_id, sign FROM a JOIN b USING (artifact_id, seg, n)"""


def iid_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = nulls.with_runs(_segmented(spark, sf_dir), 1)
    return nulls.draw_iid(tokens, "event_id").select("event_id", "sign")


IID_SQL = f"""WITH {EV}, k AS (SELECT sign, count(*) AS n FROM tok GROUP BY sign),
b AS (SELECT sign AS drawn, (sum(n) OVER (ORDER BY sign) - n)::DOUBLE / sum(n) OVER () AS low, (sum(n) OVER (ORDER BY sign))::DOUBLE / sum(n) OVER () AS high FROM k),
u AS (SELECT event_id, CAST(CAST('0x' || substr(sha256('iid|0|0|' || event_id), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE AS u FROM tok)
SELECT event_id, drawn AS sign FROM u JOIN b ON u >= low AND u < high"""


def _null_runs(spark: SparkSession, sf_dir: str, runs: int) -> DataFrame:
    """(run, perplexity, accuracy, mrr): run -1 is the observed corpus, the others shuffle both partitions apart."""
    scratch = Scratch(spark, "null-runs")
    tokens = splits.group_split(event_tokens(spark, sf_dir), "family")
    cut = sequences.segments(tokens, ["artifact_id"]).select("artifact_id", "seg", "idx", "event_id", "sign", "partition")
    cut = scratch.keep(cut, "tokens")
    moved = nulls.shuffle_signs(nulls.with_runs(cut, runs), "event_id", ["run", "partition"], scratch)
    every = scratch.keep(cut.withColumn("run", F.lit(-1).cast("bigint")).unionByName(moved.select(*cut.columns, "run")), "runs")
    sequence = ["run", *SEGMENT]
    train, test = every.filter("partition = 'train'"), every.filter("partition = 'test'")
    grams, ctx, sizes = (scratch.keep(x, "model") for x in lm.add_one(lm.contexts(train, sequence, 2), ["run"]))
    fitted = (grams, ctx, sizes)
    known = lm.contexts(lm.known_signs(test, grams, ["run"]), sequence, 2)
    held = lm.heldout_score(lm.token_probabilities(known, fitted, ["run"]), ["run"]).select("run", "perplexity")
    ranks = lm.masked_score(lm.masked_ranks(test, fitted, sequence, ["run"]), ["run"]).select("run", "accuracy", "mrr")
    return scratch.keep(held.join(ranks, "run"), "scores")


def shuffle_null_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _null_runs(spark, sf_dir, RUNS)
    long = scores.filter("run >= 0").unpivot("run", ["perplexity", "accuracy", "mrr"], "metric", "value")
    return _rounded(nulls.summary(long, "value", ["metric"]))


def empirical_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _null_runs(spark, sf_dir, RUNS)
    observed = scores.filter("run = -1").select(*(F.col(c).alias(f"o_{c}") for c in ("perplexity", "accuracy", "mrr")))
    null = scores.filter("run >= 0").crossJoin(F.broadcast(observed))  # one row
    return null.agg(
        F.round(nulls.empirical_p(F.col("perplexity"), F.col("o_perplexity"), greater=False), 6).alias("p_perplexity"),
        F.round(nulls.empirical_p(F.col("accuracy"), F.col("o_accuracy")), 6).alias("p_accuracy"),
        F.round(nulls.empirical_p(F.col("mrr"), F.col("o_mrr")), 6).alias("p_mrr"),
    )


NULL_RUNS = f"""WITH {EV}, {SPLIT}, t AS (SELECT tok.artifact_id, seg, idx, event_id, sign, partition FROM tok JOIN part USING (family)),
rr AS (SELECT range AS run FROM range({RUNS})),
a AS (SELECT run, partition, artifact_id, seg, idx, row_number() OVER (PARTITION BY run, partition ORDER BY event_id) AS n FROM t, rr),
b AS (SELECT run, partition, sign, row_number() OVER (PARTITION BY run, partition ORDER BY sha256(run || '|' || event_id), event_id) AS n FROM t, rr),
e AS (SELECT run, partition, artifact_id, seg, idx, sign FROM a JOIN b USING (run, partition, n) UNION ALL SELECT -1, partition, artifact_id, seg, idx, sign FROM t),
c AS (SELECT *, coalesce(lag(sign) OVER s, chr(0) || '<BOS>') AS l, lead(sign) OVER s AS r FROM e WINDOW s AS (PARTITION BY run, artifact_id, seg ORDER BY idx)),
g AS (SELECT run, l, sign, count(*) AS n FROM c WHERE partition = 'train' GROUP BY run, l, sign), x AS (SELECT run, l, sum(n) AS n_ctx FROM g GROUP BY run, l),
v AS (SELECT run, count(DISTINCT sign) AS v FROM g GROUP BY run),
h AS (SELECT c.run, exp(-avg(ln((coalesce(n, 0) + 1) / (coalesce(n_ctx, 0) + v + 1)::DOUBLE))) AS perplexity FROM c LEFT JOIN g USING (run, l, sign) LEFT JOIN x USING (run, l) JOIN v USING (run) WHERE partition = 'test' GROUP BY c.run),
te AS (SELECT run, sign, l, r FROM c WHERE partition = 'test'), pr AS (SELECT DISTINCT run, l, r FROM te), w AS (SELECT DISTINCT run, sign AS y FROM g),
sc AS (SELECT pr.run, pr.l, pr.r, y, ln((coalesce(g1.n, 0) + 1) / (coalesce(x1.n_ctx, 0) + v + 1)::DOUBLE) + CASE WHEN pr.r IS NULL THEN 0 ELSE ln((coalesce(g2.n, 0) + 1) / (coalesce(x2.n_ctx, 0) + v + 1)::DOUBLE) END AS s
       FROM pr JOIN w USING (run) JOIN v USING (run) LEFT JOIN g g1 ON g1.run = pr.run AND g1.l = pr.l AND g1.sign = y LEFT JOIN x x1 ON x1.run = pr.run AND x1.l = pr.l
       LEFT JOIN g g2 ON g2.run = pr.run AND g2.l = y AND g2.sign = pr.r LEFT JOIN x x2 ON x2.run = pr.run AND x2.l = y),
rk AS (SELECT *, row_number() OVER (PARTITION BY run, l, r ORDER BY round(s, 12) DESC, y) AS rank FROM sc),
m AS (SELECT te.run, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg(1.0::DOUBLE / rank) AS mrr FROM te JOIN rk ON te.run = rk.run AND te.l = rk.l AND te.r IS NOT DISTINCT FROM rk.r AND te.sign = rk.y GROUP BY te.run),
z AS (SELECT * FROM h JOIN m USING (run))"""
NULL_SQL = f"""{NULL_RUNS}, lo AS (SELECT 'perplexity' AS metric, perplexity AS value FROM z WHERE run >= 0 UNION ALL SELECT 'accuracy', accuracy FROM z WHERE run >= 0 UNION ALL SELECT 'mrr', mrr FROM z WHERE run >= 0)
SELECT metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS standard_deviation, round(min(value), 6) AS minimum, round(quantile_cont(value, 0.025), 6) AS p025,
round(median(value), 6) AS median, round(quantile_cont(value, 0.975), 6) AS p975, round(max(value), 6) AS maximum FROM lo GROUP BY metric"""
P_SQL = f"""{NULL_RUNS}, o AS (SELECT perplexity AS op, accuracy AS oa, mrr AS om FROM z WHERE run = -1)
SELECT round((1 + count(*) FILTER (perplexity <= op)) / (1 + count(*))::DOUBLE, 6) AS p_perplexity, round((1 + count(*) FILTER (accuracy >= oa)) / (1 + count(*))::DOUBLE, 6) AS p_accuracy,
round((1 + count(*) FILTER (mrr >= om)) / (1 + count(*))::DOUBLE, 6) AS p_mrr FROM z, o WHERE run >= 0"""

# ---- graphs --------------------------------------------------------------------------------------------------------------


def _document_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sequences of first letters, a vocabulary of many signs."""
    lines = document_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no", F.posexplode(F.transform(F.split("line", " "), lambda w: F.substring(F.lower(w), 1, 2))).alias("idx", "sign"))


def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _document_signs(spark, sf_dir)
    return adjacency(tokens, ["doc_id", "line_no"])[1]


EDGES = f"""WITH {DOC}, s AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS i FROM docline),
q AS (SELECT *, substr(lower(w), 1, 2) AS sign FROM s), p AS (SELECT sign AS a, lag(sign) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS b FROM q),
e AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM p WHERE b IS NOT NULL AND a <> b)"""
EDGES_SQL = f"{EDGES} SELECT u, v FROM e"


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = adjacency(_document_signs(spark, sf_dir), ["doc_id", "line_no"])
    degrees = edges.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    counted = vertices.join(degrees, vertices["sign"] == degrees["x"], "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return counted.agg(F.count("*").alias("vertices"), (F.sum("d") / 2).cast("bigint").alias("edges"), F.max("d").cast("bigint").alias("largest_degree"), F.count_if(F.col("d") == 0).alias("isolated"))


SUMMARY_SQL = f"""{EDGES}, x AS (SELECT DISTINCT sign FROM q), d AS (SELECT k, count(*) AS d FROM (SELECT u AS k FROM e UNION ALL SELECT v FROM e) GROUP BY k)
SELECT count(*) AS vertices, CAST(sum(coalesce(d, 0)) // 2 AS BIGINT) AS edges, max(coalesce(d, 0)) AS largest_degree, count(*) FILTER (coalesce(d, 0) = 0) AS isolated FROM x LEFT JOIN d ON x.sign = d.k"""


def treewidth_null(spark: SparkSession, sf_dir: str, runs: int = WIDTH_RUNS) -> DataFrame:
    """Treewidth bounds of the observed adjacency graph and of shuffled corpora, with tail rates.

    Runs are independent, so as many as WIDTH_ROWS tokens hold are shuffled at once; of
    each only its graph stays, and what they wrote is deleted before the next come.
    """
    scratch = Scratch(spark, "treewidth")
    # Two events make a sign here, else the graph would be complete at once.
    tokens = sequences.segments(event_tokens(spark, sf_dir), ["artifact_id"])
    tokens = tokens.withColumn("sign", F.concat("sign", F.lit("/"), F.hour("ts").cast("string"))).select("artifact_id", "seg", "idx", "event_id", "sign")
    tokens = scratch.keep(tokens, "tokens")
    observed = scratch.keep(adjacency(tokens.withColumn("run", F.lit(-1).cast("bigint")), ["run", *SEGMENT], ["run"])[1], "edges")
    edges = observed.unionByName(shuffled_adjacency(tokens, "event_id", SEGMENT, runs, WIDTH_ROWS, scratch, "treewidth-runs"))
    widths = scratch.keep(treewidth_bounds(edges, ["run"]), "widths")
    observed = widths.filter("run = -1").select(F.col("width").alias("observed"))
    null = widths.filter("run >= 0").crossJoin(F.broadcast(observed))  # one row
    return null.groupBy("observed").agg(F.min("width").alias("minimum"), F.avg("width").alias("mean"), F.max("width").alias("maximum"), *nulls.tail_rates(F.col("width"), F.col("observed")))


def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of each small table: row digests, sorted, digested by first letter and once more.

    Digests are grouped by their first letters, so no task holds all of them.
    """
    out = None
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
        rows = table(spark, sf_dir, name)
        digest = rows.select(F.sha2(F.concat_ws("|", F.lit(name), F.col(key).cast("string")), 256).alias("d"))
        one = commitments.order_free_digest(digest, F.col("d"))
        one = one.select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


DIGEST_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS name, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(part, '' ORDER BY p)) AS digest FROM (SELECT substr(d, 1, 3) AS p, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS part
FROM (SELECT sha256('{name}|' || {key}) AS d FROM {name}) GROUP BY 1)"""
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))
)

QUERIES = {
    "unnest_tokens": unnest_tokens, "reading_order_segments": reading_order_segments, "line_fingerprints": line_fingerprints, "length_policy": length_policy_report, "manifest_counts": manifest_counts,
    "leakage_overlap": leakage_overlap, "leakage_report": leakage_report, "unseen_test_lines": unseen_test_lines, "leakage_components": leakage_components, "family_split": family_split, "leakage_safe_split": leakage_safe_split,
    "leave_one_site_out": leave_one_site_out, "leave_one_object_type_out": leave_one_object_type_out, "leave_one_period_out": leave_one_period_out,
    "unigram_model": unigram_model, "unigram_heldout": unigram_heldout, "ngram_counts": ngram_counts, "bigram_heldout": bigram_heldout, "masked_sign_scores": masked_sign_scores,
    "global_shuffle": global_shuffle, "within_shuffle": within_shuffle, "iid_draws": iid_draws, "shuffle_null_summary": shuffle_null_summary, "empirical_p": empirical_p_values,
    "adjacency_edges": adjacency_edges, "graph_summary": graph_summary, "treewidth_null": treewidth_null, "corpus_digest": corpus_digest,
}
ORACLE_SQL = {
    "unnest_tokens": UNNEST_SQL, "reading_order_segments": SEGMENTS_SQL, "line_fingerprints": FINGERPRINT_SQL, "length_policy": LENGTH_SQL, "manifest_counts": MANIFEST_SQL,
    "leakage_overlap": OVERLAP_SQL, "leakage_report": REPORT_SQL, "unseen_test_lines": UNSEEN_SQL, "leakage_components": COMPONENTS_SQL, "family_split": FAMILY_SQL, "leakage_safe_split": SAFE_SQL,
    "leave_one_site_out": _leave_sql("documents", "source", "sha256(text)"), "leave_one_object_type_out": _leave_sql("documents", "lang", "sha256(text)"),
    "leave_one_period_out": _leave_sql("events", "strftime(ts, '%Y-%m')", "user_id"),
    "unigram_model": UNIGRAM_SQL, "unigram_heldout": UNIGRAM_HELDOUT_SQL, "ngram_counts": NGRAM_SQL, "bigram_heldout": BIGRAM_SQL, "masked_sign_scores": MASKED_SQL,
    "global_shuffle": GLOBAL_SQL, "within_shuffle": WITHIN_SQL, "iid_draws": IID_SQL, "shuffle_null_summary": NULL_SQL, "empirical_p": P_SQL,
    "adjacency_edges": EDGES_SQL, "graph_summary": SUMMARY_SQL, "corpus_digest": DIGEST_SQL,
}
