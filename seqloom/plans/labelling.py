"""Labelling queries over day lines of events: features, degradation, naive Bayes, decoding, metrics, folds, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import labelling as lab
from seqloom.operators import nulls, splits
from seqloom.plans.corpus import SPLIT
from seqloom.runtime import Scratch
from seqloom.sources.tables import event_lines

LINE = ["artifact_id", "day"]
#: The classes of the event tables.
CLASSES = ["click", "error", "purchase", "signup", "view"]
NB_FEATURES = ["form_value", "position_bucket", "line_length_bucket", "previous_equality", "next_equality"]
RUNS = 10


def classes(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types there are: a handful of names."""
    from seqloom.sources.tables import table

    return sorted(r.event_type for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with form (a band of the value; null if damaged), truth (event type), family, line and pos."""
    tokens = event_lines(spark, sf_dir).drop("sign").withColumn("band", F.floor(F.col("value") / 10).cast("bigint")).withColumn("damaged", F.col("value") < 5.0)
    return tokens.withColumn("form", F.when(~F.col("damaged"), F.concat(F.lit("f"), F.col("band").cast("string")))).withColumn("reported_direction", F.lit("known"))


LINES = """
ev AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS artifact_id, 'family:' || user_id AS family, CAST(ts AS DATE) AS day, event_type AS truth, value < 5.0 AS damaged,
       CASE WHEN value >= 5.0 THEN 'f' || CAST(floor(value / 10) AS BIGINT) END AS form, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
       count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)
"""
_EQ = "CASE WHEN {out} THEN '{b}' WHEN form IS NULL THEN 'current_missing' WHEN {o} IS NULL THEN 'neighbor_missing' WHEN form = {o} THEN 'same' ELSE 'different' END"
FEATURED = f"""{LINES},
f1 AS (SELECT *, CASE WHEN form IS NOT NULL THEN min(pos) OVER (PARTITION BY artifact_id, day, form) END AS fst, count(form) OVER (PARTITION BY artifact_id, day, form) AS uses,
  row_number() OVER (PARTITION BY artifact_id, day, form ORDER BY pos) AS nth, lag(form) OVER l AS pf, lead(form) OVER l AS nf FROM ev WINDOW l AS (PARTITION BY artifact_id, day ORDER BY pos)),
f2 AS (SELECT *, dense_rank() OVER (PARTITION BY artifact_id, day ORDER BY fst NULLS LAST) - 1 AS code FROM f1),
f3 AS (SELECT *, (CASE WHEN damaged THEN 'damaged:' ELSE 'clear:' END) || (CASE WHEN form IS NULL THEN 'missing' ELSE CAST(code AS VARCHAR) END) AS cat FROM f2),
tpl AS (SELECT artifact_id, day, sha256(string_agg(cat, ',' ORDER BY pos)) AS line_template FROM f3 GROUP BY artifact_id, day),
feat AS (SELECT f3.*, line_template, CASE WHEN n = 1 THEN 'singleton' WHEN pos = 1 THEN 'initial' WHEN pos = n THEN 'final' ELSE 'medial' END AS position_bucket,
  CASE WHEN n <= 7 THEN CAST(n AS VARCHAR) ELSE '8_plus' END AS line_length_bucket, 'known' AS reported_direction, CASE WHEN damaged THEN 'damaged' ELSE 'clear' END AS damage,
  CASE WHEN form IS NULL THEN 'missing' ELSE 'observed' END AS observation_status, {_EQ.format(out="pos = 1", b="BOS", o="pf")} AS previous_equality, {_EQ.format(out="pos = n", b="EOS", o="nf")} AS next_equality,
  CASE WHEN form IS NULL THEN 'missing' WHEN uses <= 1 THEN 'once' WHEN uses = 2 THEN 'twice' ELSE 'three_plus' END AS line_frequency_bucket,
  CASE WHEN form IS NULL THEN 'missing' WHEN nth > 1 THEN 'yes' ELSE 'no' END AS seen_before, CASE WHEN form IS NULL THEN 'missing' WHEN nth < uses THEN 'yes' ELSE 'no' END AS seen_after
  FROM f3 JOIN tpl USING (artifact_id, day))
"""


def structural_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.structural_features(lines(spark, sf_dir), LINE).select("event_id", *lab.FEATURES)


FEATURES_SQL = f"WITH {FEATURED} SELECT event_id, {', '.join(lab.FEATURES)} FROM feat"


def _degraded(spark: SparkSession, sf_dir: str, regime: str) -> DataFrame:
    tokens = lines(spark, sf_dir).drop("damaged").withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("form", F.coalesce("form", F.lit("f?")))
    return lab.degrade(tokens, "artifact_id", "day", regime)


def degrade_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mild regime: windows of 7, reversed lines, variant and damaged forms, replicas."""
    return _degraded(spark, sf_dir, "mild").select("event_id", "replica", F.col("visual_index").cast("bigint").alias("visual_index"), "observed_form", "variant", "damaged", "unknown_direction")


def _u(event: str, *keys: str) -> str:
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(CAST('0x' || substr(sha256('{event}|0|' || {joined}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0::DOUBLE)"


def _degrade_sql(regime: str, name: str) -> str:
    longest, reverse, unknown, variant, damage, duplicate = lab.REGIMES[regime]
    window = f"n <= {longest} OR (pos - 1 >= left_{name} AND pos - 1 < left_{name} + {longest})" if longest else "true"
    left = f"least(greatest(anchor - {(longest - 1) // 2}, 0), n - {longest})" if longest else "0"
    return f"""
{name}a AS (SELECT *, first_value(pos - 1) OVER (PARTITION BY artifact_id, day ORDER BY sha256('window|0|' || artifact_id || '|' || day || '|' || (pos - 1)), pos) AS anchor FROM base),
{name}w AS (SELECT * FROM (SELECT *, {left} AS left_{name} FROM {name}a) WHERE {window}),
{name} AS (SELECT event_id, artifact_id, replica, row_number() OVER (PARTITION BY artifact_id, day, replica ORDER BY CASE WHEN reversed THEN -pos ELSE pos END) - 1 AS visual_index,
  CASE WHEN NOT damaged THEN CASE WHEN variant THEN form || '~' || (pos % 3) ELSE form END END AS observed_form, variant, damaged, unknown_direction
  FROM (SELECT event_id, artifact_id, day, pos, form, {_u("reverse", "artifact_id", "day")} < {reverse} AS reversed, {_u("direction", "artifact_id", "day")} < {unknown} AS unknown_direction,
        {_u("variant", "artifact_id", "day", "pos - 1")} < {variant} AS variant, {_u("damage", "artifact_id", "day", "pos - 1")} < {damage} AS damaged,
        unnest(CASE WHEN {_u("duplicate", "artifact_id")} < {duplicate} THEN [0, 1] ELSE [0] END) AS replica FROM {name}w))"""


BASE = f"{LINES}, base AS (SELECT event_id, artifact_id, strftime(day, '%Y-%m-%d') AS day, pos, n, coalesce(form, 'f?') AS form FROM ev)"
DEGRADE_SQL = f"WITH {BASE}, {_degrade_sql('mild', 'm')} SELECT event_id, replica, visual_index, observed_form, variant, damaged, unknown_direction FROM m"


def nested_degradation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens each regime keeps, how many of the harsh ones the mild regime lacks, and readable ones."""
    mild = _degraded(spark, sf_dir, "mild").filter("replica = 0").select("event_id", F.col("observed_form").isNotNull().alias("mild_read"))
    harsh = _degraded(spark, sf_dir, "harsh").filter("replica = 0").select("event_id", F.col("observed_form").isNotNull().alias("harsh_read"))
    both = mild.join(harsh, "event_id", "full_outer")
    return both.agg(
        F.count("mild_read").alias("mild_tokens"), F.count("harsh_read").alias("harsh_tokens"), F.count_if(F.col("mild_read").isNull()).alias("harsh_only"),
        F.count_if(F.col("harsh_read") & ~F.col("mild_read")).alias("read_only_in_harsh"), F.count_if("mild_read").alias("mild_read"), F.count_if("harsh_read").alias("harsh_read"),
    )


NESTED_SQL = f"""WITH {BASE}, {_degrade_sql('mild', 'm')}, {_degrade_sql('harsh', 'h')},
b AS (SELECT a.mr, c.hr FROM (SELECT event_id, observed_form IS NOT NULL AS mr FROM m WHERE replica = 0) a FULL JOIN (SELECT event_id, observed_form IS NOT NULL AS hr FROM h WHERE replica = 0) c USING (event_id))
SELECT count(mr) AS mild_tokens, count(hr) AS harsh_tokens, count(*) FILTER (mr IS NULL) AS harsh_only, count(*) FILTER (hr AND NOT mr) AS read_only_in_harsh, count(*) FILTER (mr) AS mild_read, count(*) FILTER (hr) AS harsh_read FROM b"""

# ---- naive Bayes -----------------------------------------------------------------------------------------------------


def _examples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = lab.structural_features(lines(spark, sf_dir), LINE).withColumn("form_value", F.coalesce("form", F.lit("DAMAGED")))
    # Written once: training and test rows, masses and scores all read it.
    rows = Scratch(spark, "examples").keep(lab.family_weights(splits.group_split(rows, "family"), "family"), "rows")
    return rows.filter("partition = 'train'"), rows.filter("partition = 'test'")


EXAMPLES = f"""{FEATURED}, {SPLIT},
ex AS (SELECT feat.*, partition, coalesce(form, 'DAMAGED') AS form_value, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS weight FROM feat JOIN part USING (family))"""
LONG = f"""{EXAMPLES}, lo AS (UNPIVOT (SELECT event_id, truth, weight, partition, {', '.join(NB_FEATURES)} FROM ex) ON {', '.join(NB_FEATURES)} INTO NAME feature VALUE value),
cm AS (SELECT truth, sum(weight) AS class_mass FROM ex WHERE partition = 'train' GROUP BY truth),
fm AS (SELECT feature, value, truth, sum(weight) AS mass FROM lo WHERE partition = 'train' GROUP BY feature, value, truth)"""


def nb_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _examples(spark, sf_dir)
    return lab.feature_masses(train, NB_FEATURES).select("feature", "value", "truth", F.round("mass", 6).alias("mass"))


MASSES_SQL = f"WITH {LONG} SELECT feature, value, truth, round(mass, 6) AS mass FROM fm"


def nb_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _examples(spark, sf_dir)
    return lab.bayes_scores(test, train, NB_FEATURES, ["event_id"], classes(spark, sf_dir))


PREDICTED = f"""{LONG}, vs AS (SELECT feature, count(DISTINCT value) AS v FROM fm GROUP BY feature), tm AS (SELECT sum(class_mass) AS total, count(*) AS k FROM cm),
sc AS (SELECT event_id, lo.truth, cm.truth AS c, sum(ln((coalesce(mass, 0) + 1) / (class_mass + v + 1))) + any_value(ln((class_mass + 1) / (total + k))) AS s
       FROM lo JOIN vs USING (feature) CROSS JOIN cm CROSS JOIN tm LEFT JOIN fm ON fm.feature = lo.feature AND fm.value = lo.value AND fm.truth = cm.truth WHERE partition = 'test' GROUP BY event_id, lo.truth, cm.truth),
pd AS (SELECT event_id, truth, c AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(s, 9) DESC, c) AS r FROM sc) WHERE r = 1)"""
PREDICTIONS_SQL = f"WITH {PREDICTED} SELECT event_id, truth, predicted FROM pd"


def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _examples(spark, sf_dir)
    rows = test.crossJoin(F.broadcast(lab.majority(train)))  # one row
    return rows.groupBy("predicted").agg(F.round(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("weight")).otherwise(0.0)) / F.sum("weight"), 6).alias("accuracy"))


MAJORITY_SQL = f"""WITH {EXAMPLES}, m AS (SELECT truth AS predicted FROM ex WHERE partition = 'train' GROUP BY truth ORDER BY round(sum(weight), 9) DESC, truth LIMIT 1)
SELECT predicted, round(sum(CASE WHEN truth = predicted THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM ex, m WHERE partition = 'test' GROUP BY predicted"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _examples(spark, sf_dir)
    found = lab.bayes_scores(test, train, NB_FEATURES, ["event_id"], classes(spark, sf_dir))
    return found.join(test.select("event_id", "weight"), "event_id")


def weighted_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.confusion(_scored(spark, sf_dir)).select("truth", "predicted", F.round("mass", 6).alias("mass"))


CONFUSION = f"{PREDICTED}, cf AS (SELECT pd.truth, predicted, sum(weight) AS mass FROM pd JOIN ex USING (event_id) GROUP BY pd.truth, predicted)"
CONFUSION_SQL = f"WITH {CONFUSION} SELECT truth, predicted, round(mass, 6) AS mass FROM cf"


def state_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = lab.class_metrics(lab.confusion(_scored(spark, sf_dir)), classes(spark, sf_dir))
    return metrics.select(F.col("class").alias("state"), *(F.round(c, 6).alias(c) for c in ("truth_mass", "predicted_mass", "precision", "recall", "f1")))


RATED = f"""{CONFUSION}, k AS (SELECT DISTINCT truth AS c FROM ex),
su AS (SELECT c, coalesce(sum(mass) FILTER (truth = c AND predicted = c), 0) AS hit, coalesce(sum(mass) FILTER (truth = c), 0) AS tmass, coalesce(sum(mass) FILTER (predicted = c), 0) AS pmass FROM cf, k GROUP BY c),
ra AS (SELECT *, CASE WHEN pmass > 0 THEN hit / pmass ELSE 0 END AS p, CASE WHEN tmass > 0 THEN hit / tmass END AS r FROM su),
rf AS (SELECT *, CASE WHEN p + coalesce(r, 0) > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ra)"""
METRICS_SQL = f"WITH {RATED} SELECT c AS state, round(tmass, 6) AS truth_mass, round(pmass, 6) AS predicted_mass, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM rf"


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds over the summary metrics, and the status they give."""
    summary = lab.summary_metrics(lab.class_metrics(lab.confusion(_scored(spark, sf_dir)), classes(spark, sf_dir)))
    gated = lab.gates(summary, [("accuracy", ">=", 0.15), ("macro_f1", ">=", 0.35), ("worst_recall", ">", 0.0)])
    return gated.select("metric", F.round("value", 6).alias("value"), "threshold", "passed")


GATE_SQL = f"""WITH {RATED}, s AS (SELECT sum(hit) / sum(tmass) AS accuracy, avg(f) AS macro_f1, min(r) AS worst_recall FROM rf)
SELECT 'accuracy' AS metric, round(accuracy, 6) AS value, 0.15::DOUBLE AS threshold, accuracy >= 0.15 AS passed FROM s UNION ALL SELECT 'macro_f1', round(macro_f1, 6), 0.35, macro_f1 >= 0.35 FROM s
UNION ALL SELECT 'worst_recall', round(worst_recall, 6), 0.0, worst_recall > 0 FROM s"""


def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.family_coverage(lines(spark, sf_dir), "family").select("truth", F.round("coverage", 6).alias("coverage"))


COVERAGE_SQL = f"WITH {LINES}, e AS (SELECT family, truth, count(form) / count(*)::DOUBLE AS s FROM ev GROUP BY family, truth) SELECT truth, round(avg(s), 6) AS coverage FROM e GROUP BY truth"


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab.family_weights(lines(spark, sf_dir), "family")
    return lab.transition_matrix(rows, LINE, classes(spark, sf_dir)).select("previous", "following", F.round("mass", 6).alias("mass"), F.round("log_probability", 6).alias("log_probability"))


TRANSITION = f"""{LINES}, w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS weight, lag(truth) OVER (PARTITION BY artifact_id, day ORDER BY pos) AS previous FROM ev),
k AS (SELECT DISTINCT truth AS c FROM ev), pm AS (SELECT previous, truth AS following, sum(weight) AS mass FROM w WHERE previous IS NOT NULL GROUP BY previous, truth),
fl AS (SELECT a.c AS previous, b.c AS following, coalesce(mass, 0) AS mass FROM k a CROSS JOIN k b LEFT JOIN pm ON pm.previous = a.c AND pm.following = b.c),
tr AS (SELECT *, ln((mass + 1) / (sum(mass) OVER (PARTITION BY previous) + (SELECT count(*) FROM k))) AS lp FROM fl)"""
TRANSITION_SQL = f"WITH {TRANSITION} SELECT previous, following, round(mass, 6) AS mass, round(lp, 6) AS log_probability FROM tr"


def start_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lab.start_masses(lines(spark, sf_dir), LINE, "family", classes(spark, sf_dir))
    return found.select("truth", F.round("mass", 6).alias("mass"), F.round("log_probability", 6).alias("log_probability"))


START_SQL = f"""WITH {LINES}, s AS (SELECT family, truth, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS share FROM ev WHERE pos = 1),
k AS (SELECT truth, coalesce(mass, 0) AS mass FROM (SELECT DISTINCT truth FROM ev) LEFT JOIN (SELECT truth, sum(share) AS mass FROM s GROUP BY truth) USING (truth))
SELECT truth, round(mass, 6) AS mass, round(ln((mass + 1) / (sum(mass) OVER () + count(*) OVER ())), 6) AS log_probability FROM k"""


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipliers that halve the classes' imbalance, of family-weighted tokens that can be read."""
    rows = lab.family_weights(lines(spark, sf_dir).filter("form IS NOT NULL"), "family")
    found = lab.class_balance(lab.class_masses(rows), 0.5)
    return found.select("truth", F.round("class_mass", 6).alias("class_mass"), F.round("multiplier", 6).alias("multiplier"))


BALANCE_SQL = f"""WITH {LINES}, w AS (SELECT truth, 1.0::DOUBLE / count(*) OVER (PARTITION BY family) AS weight FROM ev WHERE form IS NOT NULL),
m AS (SELECT truth, sum(weight) AS mass FROM w GROUP BY truth), r AS (SELECT *, sqrt(sum(mass) OVER () / count(*) OVER () / mass) AS raw FROM m)
SELECT truth, round(mass, 6) AS class_mass, round(raw * sum(mass) OVER () / sum(mass * raw) OVER (), 6) AS multiplier FROM r"""


def movable_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.movable(_vectors(spark, sf_dir), "unit").select("units", "movable", F.round("fraction", 9).alias("fraction"))


MOVABLE_SQL = f"""WITH {LINES}, z AS (SELECT artifact_id, day, count(*) AS size FROM ev GROUP BY artifact_id, day), g AS (SELECT size, count(*) AS n FROM z GROUP BY size)
SELECT CAST(sum(n) AS BIGINT) AS units, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS movable, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 9) AS fraction FROM g"""


def viterbi_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each day line under naive Bayes emissions of its forms and the transition matrix."""
    names = classes(spark, sf_dir)
    scratch = Scratch(spark, "viterbi")
    rows = scratch.keep(lab.family_weights(lines(spark, sf_dir), "family").withColumn("form_value", F.coalesce("form", F.lit("DAMAGED"))), "lines")
    masses = {r.truth: r.class_mass for r in lab.class_masses(rows).collect()}
    by_form = lab.feature_masses(rows, ["form_value"])
    n = by_form.select("value").distinct().count()
    emission = by_form.groupBy(F.col("value").alias("form_value")).agg(
        F.array(*(F.round(F.ln((F.coalesce(F.sum(F.when(F.col("truth") == c, F.col("mass"))), F.lit(0.0)) + 1) / F.lit(masses[c] + n)), 9) for c in names)).alias("emission")
    )
    log = {(r.previous, r.following): round(r.log_probability, 9) for r in lab.transition_matrix(rows, LINE, names).collect()}  # classes squared
    transition = F.array(*(F.array(*(F.lit(log[a, b]) for b in names)) for a in names))
    start = F.array(*(F.lit(0.0) for _ in names))
    paths = rows.join(emission, "form_value").groupBy(*LINE).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "emission"))), lambda t: t["emission"]).alias("emissions"))
    best = lab.viterbi(F.col("emissions"), start, transition, 1.0, len(names))
    return paths.select("artifact_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join(F.transform(best, lambda s: F.element_at(F.array(*map(F.lit, names)), s + 1)), ",").alias("states"))


def type_profile_lofo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lab.type_profiles(lines(spark, sf_dir), LINE, "family")
    return found.select("form", "family", "own_n", "support", *(F.round(c, 6).alias(c) for c in ("mean_position", "position_variance", "initial_rate", "final_rate")))


LOFO_SQL = f"""WITH {LINES}, a AS (SELECT *, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE (pos - 1)::DOUBLE / (n - 1) END AS place FROM ev WHERE form IS NOT NULL),
fa AS (SELECT DISTINCT form, family FROM a), o AS (SELECT fa.form, fa.family, count(*) AS support, avg(place) AS m, avg(place * place) AS q, avg(CASE WHEN pos = 1 THEN 1.0::DOUBLE ELSE 0 END) AS i, avg(CASE WHEN pos = n THEN 1.0::DOUBLE ELSE 0 END) AS e
FROM fa JOIN a ON a.form = fa.form AND a.family <> fa.family GROUP BY fa.form, fa.family), c AS (SELECT form, family, count(*) AS own_n FROM a GROUP BY form, family)
SELECT form, family, own_n, support, round(m, 6) AS mean_position, round(greatest(0, q - m * m), 6) AS position_variance, round(i, 6) AS initial_rate, round(e, 6) AS final_rate FROM o JOIN c USING (form, family)"""


def context_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.context_entropy(lines(spark, sf_dir), LINE).select("form", F.round("entropy", 6).alias("entropy"))


ENTROPY_SQL = f"""WITH {LINES}, b AS (SELECT form, coalesce(lag(form) OVER (PARTITION BY artifact_id, day ORDER BY pos), 'BOS') AS before FROM ev),
c AS (SELECT form, before, count(*) AS n FROM b WHERE form IS NOT NULL GROUP BY form, before), p AS (SELECT form, n / sum(n) OVER (PARTITION BY form) AS p FROM c)
SELECT form, round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY form"""


def family_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.family_support(lines(spark, sf_dir), "family", classes(spark, sf_dir))


SUPPORT_SQL = f"WITH {LINES} SELECT family, " + ", ".join(f"count(*) FILTER (truth = '{c}') AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM ev GROUP BY family"


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = classes(spark, sf_dir)
    return lab.greedy_folds(lab.family_support(lines(spark, sf_dir), "family", names), "family", names, 5)


def one_se_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of event types as candidates, scored by day: the simplest within one standard error of the best."""
    tokens = lines(spark, sf_dir)
    scores = tokens.groupBy(F.col("truth").alias("candidate"), F.length("truth").cast("bigint").alias("complexity"), F.expr("pmod(CAST(artifact_id AS BIGINT), 5)").alias("fold")).agg(F.avg((F.col("pos") == 1).cast("double")).alias("score"))
    return lab.one_standard_error(scores).select("candidate", "complexity", F.round("mean", 6).alias("mean"), F.round("cutoff", 6).alias("cutoff"))


ONE_SE_SQL = f"""WITH {LINES}, s AS (SELECT truth AS candidate, length(truth) AS complexity, CAST(artifact_id AS BIGINT) % 5 AS fold, avg(CASE WHEN pos = 1 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM ev GROUP BY ALL),
e AS (SELECT candidate, complexity, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS se FROM s GROUP BY candidate, complexity),
b AS (SELECT mean - se AS cutoff FROM e ORDER BY round(mean, 9) DESC, complexity LIMIT 1)
SELECT candidate, complexity, round(mean, 6) AS mean, round(cutoff, 6) AS cutoff FROM e, b WHERE mean >= cutoff ORDER BY complexity, round(mean, 9) DESC, candidate LIMIT 1"""

# ---- permutation -----------------------------------------------------------------------------------------------------


def family_label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One permutation of label vectors among users with equally many tokens that day line by line."""
    tokens = _vectors(spark, sf_dir)
    return lab.permuted_labels(tokens, "unit", 1, ["ts", "event_id"]).select("event_id", "truth")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day lines as the units whose label vectors move: many of them have equal lengths."""
    return lines(spark, sf_dir).withColumn("unit", F.concat_ws("/", "artifact_id", F.date_format("day", "yyyy-MM-dd")))


VECTORS = f"{LINES}, un AS (SELECT *, artifact_id || '/' || strftime(day, '%Y-%m-%d') AS unit FROM ev)"


def _permuted(runs: int) -> str:
    return f"""{VECTORS}, sz AS (SELECT unit, count(*) AS size FROM un GROUP BY unit), al AS (SELECT unit, size, range AS run FROM sz, range({runs})),
re AS (SELECT *, row_number() OVER (PARTITION BY run, size ORDER BY unit) AS k FROM al), dn AS (SELECT run, size, unit AS donor, row_number() OVER (PARTITION BY run, size ORDER BY sha256(run || '|' || size || '|' || unit), unit) AS k FROM al),
pa AS (SELECT run, unit, donor FROM re JOIN dn USING (run, size, k)),
pl AS (SELECT un.event_id, un.unit, un.family, un.form, un.artifact_id, un.day, un.pos, un.n, run, d.truth AS truth FROM un JOIN pa USING (unit) JOIN un d ON d.unit = pa.donor AND d.pos = un.pos)"""


PERMUTATION_SQL = f"WITH {_permuted(1)} SELECT event_id, truth FROM pl"


def permutation_null_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of reading the class from the form, observed and under permuted labels, with its empirical p.

    Each run's classifier is the class of largest count for each form.
    """
    scratch = Scratch(spark, "permutation")
    tokens = scratch.keep(_vectors(spark, sf_dir).filter("form IS NOT NULL OR damaged"), "vectors")
    moved = lab.permuted_labels(tokens, "unit", RUNS, ["ts", "event_id"])
    every = tokens.withColumn("run", F.lit(-1).cast("bigint")).unionByName(moved.select(*tokens.columns, "run"))
    counts = scratch.keep(every.withColumn("form", F.coalesce("form", F.lit("DAMAGED"))).groupBy("run", "form", "truth").agg(F.count("*").cast("double").alias("mass")), "counts")
    # Ties go to the class that sorts first.
    best = counts.groupBy("run", "form").agg(F.min(F.struct((-F.col("mass")).alias("m"), F.col("truth").alias("c"))).alias("b")).select("run", "form", F.col("b.c").alias("predicted"))
    matrix = counts.join(best, ["run", "form"]).groupBy("run", "truth", "predicted").agg(F.sum("mass").alias("mass"))
    scores = scratch.keep(lab.summary_metrics(lab.class_metrics(matrix, classes(spark, sf_dir), ["run"]), ["run"]), "scores")
    observed = scores.filter("run = -1").select(F.col("macro_f1").alias("observed"))
    null = scores.filter("run >= 0").crossJoin(F.broadcast(observed))  # one row
    return null.groupBy("observed").agg(F.round(F.avg("macro_f1"), 6).alias("null_mean"), F.round(nulls.empirical_p(F.round("macro_f1", 9), F.round("observed", 9)), 6).alias("p")).select(F.round("observed", 6).alias("observed"), "null_mean", "p")


PERMUTED_F1_SQL = f"""WITH {_permuted(RUNS)}, ev2 AS (SELECT -1 AS run, form, truth FROM ev UNION ALL SELECT run, form, truth FROM pl),
ct AS (SELECT run, coalesce(form, 'DAMAGED') AS form, truth, count(*)::DOUBLE AS mass FROM ev2 GROUP BY ALL), be AS (SELECT run, form, truth AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY run, form ORDER BY mass DESC, truth) AS r FROM ct) WHERE r = 1),
mx AS (SELECT run, truth, predicted, sum(mass) AS mass FROM ct JOIN be USING (run, form) GROUP BY ALL), k AS (SELECT DISTINCT truth AS c FROM ev),
su AS (SELECT run, c, coalesce(sum(mass) FILTER (truth = c AND predicted = c), 0) AS hit, coalesce(sum(mass) FILTER (truth = c), 0) AS t, coalesce(sum(mass) FILTER (predicted = c), 0) AS p FROM mx, k GROUP BY run, c),
rf AS (SELECT run, CASE WHEN p > 0 AND hit > 0 THEN 2 * (hit / p) * (hit / t) / (hit / p + hit / t) ELSE 0 END AS f FROM su), z AS (SELECT run, avg(f) AS f1 FROM rf GROUP BY run), o AS (SELECT f1 AS observed FROM z WHERE run = -1)
SELECT round(observed, 6) AS observed, round(avg(f1), 6) AS null_mean, round((1 + count(*) FILTER (round(f1, 9) >= round(observed, 9))) / (1 + count(*))::DOUBLE, 6) AS p FROM z, o WHERE run >= 0 GROUP BY observed"""

QUERIES = {
    "structural_features": structural_features, "degrade_tokens": degrade_tokens, "nested_degradation_check": nested_degradation_check, "nb_masses": nb_masses, "nb_predictions": nb_predictions,
    "majority_baseline": majority_baseline, "weighted_confusion": weighted_confusion, "state_metrics": state_metrics, "gate_decision": gate_decision, "family_coverage": family_coverage,
    "start_masses": start_masses, "class_balance": class_balance, "movable_fraction": movable_fraction,
    "transition_matrix": transition_matrix, "viterbi_states": viterbi_states, "type_profile_lofo": type_profile_lofo, "context_entropy": context_entropy, "family_support": family_support,
    "grouped_folds": grouped_folds, "one_se_selection": one_se_selection, "family_label_permutation": family_label_permutation, "permutation_null_f1": permutation_null_f1,
}
ORACLE_SQL = {
    "structural_features": FEATURES_SQL, "degrade_tokens": DEGRADE_SQL, "nested_degradation_check": NESTED_SQL, "nb_masses": MASSES_SQL, "nb_predictions": PREDICTIONS_SQL, "majority_baseline": MAJORITY_SQL,
    "weighted_confusion": CONFUSION_SQL, "state_metrics": METRICS_SQL, "gate_decision": GATE_SQL, "family_coverage": COVERAGE_SQL, "transition_matrix": TRANSITION_SQL, "type_profile_lofo": LOFO_SQL,
    "start_masses": START_SQL, "class_balance": BALANCE_SQL, "movable_fraction": MOVABLE_SQL,
    "context_entropy": ENTROPY_SQL, "family_support": SUPPORT_SQL, "one_se_selection": ONE_SE_SQL, "family_label_permutation": PERMUTATION_SQL, "permutation_null_f1": PERMUTED_F1_SQL,
}
