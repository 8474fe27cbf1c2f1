"""Review ledgers: supersession, as-of counts, agreement, policy coverage, adjudication checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def supersession_edges(reviews: DataFrame, protected: list[str]) -> DataFrame:
    """(review_id, target, problem): each review that supersedes another, and what is wrong with it (null if nothing).

    reviews: review_id, supersedes, at and the protected columns, which must not change.
    """
    old = reviews.select(F.col("review_id").alias("target"), F.col("at").alias("__at"), *(F.col(c).alias(f"__{c}") for c in protected), F.lit(True).alias("__there"))
    joined = reviews.filter("supersedes IS NOT NULL").withColumn("target", F.col("supersedes")).join(old, "target", "left")
    others = F.count("*").over(W.partitionBy("target"))
    changed = F.lit(False)
    for c in protected:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    problem = (
        F.when(F.col("__there").isNull(), "unknown_review")
        .when(others > 1, "multiple_successors")
        .when(changed, "protected_field_changed")
        .when(F.col("at") <= F.col("__at"), "not_later")
    )
    return joined.select("review_id", "target", problem.alias("problem"))


def eligible_as_of(reviews: DataFrame, edges: DataFrame, decisions: DataFrame, subject: str) -> DataFrame:
    """decisions with eligible: how many complete reviews of their subject counted when they were made.

    A review counts from its own time until its valid successor's. All events of a
    subject stand on one line of time and a running sum reads the count at each
    decision; nothing is joined by range.
    """
    good = edges.filter("problem IS NULL").select(F.col("target").alias("review_id"), F.col("review_id").alias("__by"))
    times = reviews.select(F.col("review_id").alias("__by"), F.col("at").alias("__ends"))
    own = reviews.filter("complete").join(good.join(times, "__by"), "review_id", "left")
    none = F.lit(None).cast(dict(decisions.dtypes)["decision_id"])
    starts = own.select(subject, "at", F.lit(1).alias("delta"), none.alias("decision_id"))
    ends = own.filter("__ends IS NOT NULL").select(subject, F.col("__ends").alias("at"), F.lit(-1).alias("delta"), none.alias("decision_id"))
    asks = decisions.select(subject, "at", F.lit(0).alias("delta"), "decision_id")
    line = starts.unionByName(ends).unionByName(asks)
    upto = F.sum("delta").over(W.partitionBy(subject).orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    return line.withColumn("eligible", upto).filter("decision_id IS NOT NULL").select("decision_id", subject, "eligible")


def agreement(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """(pairs, rate of agreement for each field) of aligned pairs with columns l_field and r_field."""
    return pairs.agg(F.count("*").alias("pairs"), *(F.avg(F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")).cast("double")).alias(f"{f}_agreement") for f in fields))


def alignment_scores(pairs: Column, left: Column, right: Column) -> list[Column]:
    """Precision, recall and F1 of an alignment from counts."""
    return [(pairs / left).alias("precision"), (pairs / right).alias("recall"), (2 * pairs / (left + right)).alias("f1")]


def policy_coverage(inventory: DataFrame, policy: DataFrame, key: str, reasons: list[tuple[str, Column]]) -> DataFrame:
    """(key, coverage, reasons): a full outer join of files and policy entries, with every reason that applies.

    reasons are (code, condition that blocks); the columns are named as in the two
    tables, which share nothing but key.
    """
    files, entries = inventory.withColumn("__file", F.lit(True)), policy.withColumn("__entry", F.lit(True))
    both = files.join(entries, key, "full_outer")
    coverage = F.when(F.col("__entry").isNull(), "uncovered").when(F.col("__file").isNull(), "extra").otherwise("covered")
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), code) for code, c in reasons))))
    return both.select(key, coverage.alias("coverage"), F.when(coverage == "covered", found).otherwise(F.array(F.lit("RIGHTS_COVERAGE_INCOMPLETE"))).alias("reasons"))


def no_invention(decisions: DataFrame, inputs: DataFrame, key: list[str], value: str) -> DataFrame:
    """Decisions whose value no input has: (key, value)."""
    return decisions.join(inputs.select(*key, value).distinct(), [*key, value], "left_anti")


def ready_totals(subjects: DataFrame, errors: DataFrame) -> DataFrame:
    """Totals that fall to zero if there is any error: a broken ledger supports nothing."""
    broken = errors.agg(F.count("*").alias("errors"))
    sums = subjects.agg(F.count("*").alias("subjects"), F.count_if("ready").alias("ready"))
    return sums.crossJoin(broken).select("subjects", "errors", F.when(F.col("errors") > 0, 0).otherwise(F.col("ready")).alias("ready"))


def adjudication_problems(reviews: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(decision_id, problem) of adjudications that don't stand; each problem once.

    reviews: review_id, subject_id, assignment_id, actor_id, at, complete, stage
    (independent or adjudication), supersedes, inputs (ids, for adjudications). Inputs
    must be all complete independent reviews that counted when the decision was made,
    of its subject, not later and not superseded by then; they must come from at least
    `least` people and assignments, none of them the decision's own.
    """
    decisions = reviews.filter("stage = 'adjudication'").select(F.col("review_id").alias("decision_id"), "subject_id", "assignment_id", "actor_id", "at", "inputs")
    eligible = eligible_as_of(reviews.filter("stage = 'independent'"), edges, decisions, "subject_id").select("decision_id", "eligible")
    short = decisions.join(eligible, "decision_id").filter(F.size("inputs") != F.col("eligible")).select("decision_id", F.lit("inputs_do_not_cover").alias("problem"))
    named = decisions.select("decision_id", F.col("subject_id").alias("d_subject"), F.col("assignment_id").alias("d_assignment"), F.col("actor_id").alias("d_actor"), F.col("at").alias("d_at"), F.explode("inputs").alias("review_id"))
    gone = edges.filter("problem IS NULL").select(F.col("target").alias("review_id"), F.col("review_id").alias("__by")).join(reviews.select(F.col("review_id").alias("__by"), F.col("at").alias("gone_at")), "__by").drop("__by")
    met = named.join(reviews.drop("inputs", "supersedes"), "review_id", "left").join(gone, "review_id", "left")
    usable = F.col("stage").eqNullSafe("independent") & (F.col("subject_id") == F.col("d_subject"))
    each = F.array_compact(F.array(
        F.when(F.col("stage").isNull(), "missing_input"), F.when(F.col("stage") == "adjudication", "input_not_independent"), F.when(~F.col("complete"), "input_incomplete"), F.when(F.col("subject_id") != F.col("d_subject"), "input_of_other_subject"),
        F.when(F.col("at") > F.col("d_at"), "input_later"), F.when(F.col("gone_at") <= F.col("d_at"), "input_superseded"),
    ))
    single = met.select("decision_id", F.explode(each).alias("problem"))
    people = met.groupBy("decision_id").agg(
        F.count_distinct(F.when(usable, F.col("actor_id"))).alias("actors"), F.count_distinct(F.when(usable, F.col("assignment_id"))).alias("assignments"),
        F.max(F.when(usable, F.col("actor_id") == F.col("d_actor"))).alias("own"), F.max(F.when(usable, F.col("assignment_id") == F.col("d_assignment"))).alias("reused"),
    )
    whole = decisions.select("decision_id").join(people, "decision_id", "left")
    few = F.array_compact(F.array(
        F.when(F.coalesce("actors", F.lit(0)) < least, "too_few_actors"), F.when(F.coalesce("assignments", F.lit(0)) < least, "too_few_assignments"), F.when(F.col("own"), "adjudicator_is_author"), F.when(F.col("reused"), "assignment_reused")
    ))
    return short.unionByName(single).unionByName(whole.select("decision_id", F.explode(few).alias("problem"))).distinct()


def ledger_totals(reviews: DataFrame, protected: list[str], least: int = 2) -> DataFrame:
    """One row: reviews, subjects with enough independent ones, sound decisions, errors; any error makes the middle two zero."""
    edges = supersession_edges(reviews, protected)
    problems = adjudication_problems(reviews, edges, least)
    wrong = edges.filter("problem IS NOT NULL").select("problem").unionAll(problems.select("problem")).agg(F.count("*").alias("errors"))
    replaced = edges.filter("problem IS NULL").select(F.col("target").alias("review_id"))
    active = reviews.join(replaced, "review_id", "left_anti")
    ready = active.filter("stage = 'independent' AND complete").groupBy("subject_id").agg(F.count_distinct("actor_id").alias("a"), F.count_distinct("assignment_id").alias("b")).filter((F.col("a") >= least) & (F.col("b") >= least)).agg(F.count("*").alias("ready"))
    sound = active.filter("stage = 'adjudication' AND complete").join(problems.withColumnRenamed("decision_id", "review_id"), "review_id", "left_anti").agg(F.count("*").alias("sound"))
    total = reviews.agg(F.count("*").alias("reviews"))
    closed = lambda c: F.when(F.col("errors") > 0, 0).otherwise(F.col(c))
    return total.crossJoin(ready).crossJoin(sound).crossJoin(wrong).select("reviews", closed("ready").alias("ready_subjects"), closed("sound").alias("sound_decisions"), "errors")  # one row each


def comparison(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One row: how two reviewers' cells (key, sign, x0, y0, x1, y1) agree in what is filled, read and outlined."""
    from seqloom.operators.matching import box_overlap

    box = ("x0", "y0", "x1", "y1")
    named = [df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in ("sign", *box)), F.lit(True).alias(f"{p}_there")) for df, p in ((left, "l"), (right, "r"))]
    both = named[0].join(named[1], key, "full_outer")
    shared = F.col("l_there") & F.col("r_there")
    overlap = box_overlap(*([F.col(f"{p}_{c}") for c in box] for p in ("l", "r")))
    return both.agg(
        F.count("*").alias("cells"), F.count_if(shared).alias("shared"), (F.count_if(shared) / F.count("*")).alias("occupancy_agreement"),
        F.avg(F.when(shared, F.col("l_sign").eqNullSafe(F.col("r_sign")).cast("double"))).alias("sign_agreement"), F.avg(F.when(shared, overlap)).alias("mean_overlap"),
    )


def staged_artifacts(tokens: DataFrame, problems: DataFrame) -> DataFrame:
    """Nested artifacts of adjudicated tokens (artifact_id, decision_id, side_id, line_id, visual_index, sign_id) whose decision has no problem."""
    good = tokens.join(problems.select("decision_id"), "decision_id", "left_anti")
    lines = good.groupBy("artifact_id", "decision_id", "side_id", "line_id").agg(F.array_sort(F.collect_list(F.struct("visual_index", "sign_id"))).alias("tokens"))
    sides = lines.groupBy("artifact_id", "decision_id", "side_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "tokens"))).alias("lines"))
    return sides.groupBy("artifact_id", "decision_id").agg(F.array_sort(F.collect_list(F.struct("side_id", "lines"))).alias("sides"))
