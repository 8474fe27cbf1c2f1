"""Quarantine rules, rights gates and registry lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import normal_text

#: Purposes that look without using anything.
LOOKING = ("audit_only", "schema_validation")
#: Purposes that need leave to pass data on.
PASSING_ON = ("corpus_ingestion", "training", "redistribution")
#: A rule table larger than this is not broadcast.
RULES_IN_BROADCAST = 10_000


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule_id, matcher, pattern) of rules (rule_id, source_ids, locator_prefixes, revisions), patterns normalised."""
    parts = [("source_id", "source_ids", False), ("locator_prefix", "locator_prefixes", True), ("revision", "revisions", True)]
    out = None
    for matcher, column, folded in parts:
        own = rules.select("rule_id", F.lit(matcher).alias("matcher"), F.explode(column).alias("pattern"))
        own = own.withColumn("pattern", normal_text(F.col("pattern"))) if folded else own
        out = own if out is None else out.unionByName(own)
    return out


def locator_matches(rows: DataFrame, patterns: DataFrame, locator: str) -> DataFrame:
    """rows with the rule_id of each pattern that their normalised locator starts with.

    A prefix test is an equality for each length that patterns have: a locator is cut to
    those lengths and hash-joined, so no row meets rules that can't match it. The lengths
    are few, however many rules there are.
    """
    sized = patterns.withColumn("__size", F.length("pattern"))
    lengths = sorted(r[0] for r in sized.select("__size").distinct().collect())
    if not lengths:
        return rows.limit(0).withColumn("rule_id", F.lit(None).cast("string"))
    normal = rows.withColumn("__locator", normal_text(F.col(locator)))
    cut = normal.withColumn("__size", F.explode(F.array(*(F.lit(n) for n in lengths)))).filter(F.length("__locator") >= F.col("__size"))
    cut = cut.withColumn("__head", F.substring(F.col("__locator"), F.lit(1), F.col("__size")))
    small = sized.limit(RULES_IN_BROADCAST + 1).count() <= RULES_IN_BROADCAST
    side = F.broadcast(sized) if small else sized
    return cut.join(side, (cut["__size"] == side["__size"]) & (cut["__head"] == side["pattern"])).select(*(normal[c] for c in rows.columns), "rule_id")


def rights_finding(status: Column, derivatives: Column, redistribution: Column, purpose: str) -> Column:
    """The first reason why rights don't allow a purpose, null if they do."""
    if purpose in LOOKING:
        return F.lit(None).cast("string")
    reason = F.when(status.isNull() | status.isin("restricted", "unknown"), "rights_status_not_permitted")
    if purpose != "final_evaluation":
        reason = reason.when(~F.coalesce(derivatives, F.lit(False)), "derivatives_not_permitted")
    if purpose in PASSING_ON:
        reason = reason.when(~F.coalesce(redistribution, F.lit(False)), "redistribution_not_permitted")
    return reason


def inspect(references: DataFrame, registry: DataFrame, rules: DataFrame, purpose: str, internal: list[str] | None = None) -> DataFrame:
    """(artifact_id, code, source_id, rule_id) findings of references (artifact_id, source_id, locator, revision).

    Missing and unknown sources, rights that don't allow the purpose, and rules that
    match by source, locator prefix or revision and forbid it. Each finding once.
    """
    internal = internal or []
    none = F.lit(None).cast("string")
    known = references.join(registry.select("source_id", "status", "derivatives", "redistribution", F.lit(True).alias("__known")), "source_id", "left")
    outside = ~F.coalesce(F.col("source_id").isin(internal), F.lit(False)) if internal else F.lit(True)
    reason = rights_finding(F.col("status"), F.col("derivatives"), F.col("redistribution"), purpose)
    code = F.when(F.col("source_id").isNull() | (F.col("source_id") == ""), "source_id_missing").when(outside & F.col("__known").isNull(), "unknown_source_id").when(outside, reason)
    first = known.select("artifact_id", code.alias("code"), "source_id", none.alias("rule_id")).filter("code IS NOT NULL")
    active = rules if purpose in LOOKING else rules.filter(F.array_contains("prohibited_purposes", purpose))
    patterns = rule_table(active)
    by_source = references.join(patterns.filter("matcher = 'source_id'"), F.col("source_id") == F.col("pattern")).select("artifact_id", "source_id", "rule_id")
    by_locator = locator_matches(references.select("artifact_id", "source_id", "locator"), patterns.filter("matcher = 'locator_prefix'"), "locator").select("artifact_id", "source_id", "rule_id")
    revisions = patterns.filter("matcher = 'revision'")
    by_revision = references.withColumn("__r", normal_text(F.col("revision"))).join(revisions, F.col("__r") == F.col("pattern")).select("artifact_id", "source_id", "rule_id")
    matched = by_source.unionByName(by_locator).unionByName(by_revision).select("artifact_id", F.lit("quarantine_rule_match").alias("code"), "source_id", "rule_id")
    return first.unionByName(matched).distinct()


def require_permitted(findings: DataFrame) -> None:
    """Raise if there is any finding."""
    if not findings.isEmpty():
        sample = [tuple(r) for r in findings.orderBy("artifact_id", "code").limit(5).collect()]
        raise PermissionError(f"the corpus may not be used for this: {sample}")


def admitted(records: DataFrame, marker: str) -> DataFrame:
    """records, guarded: evaluating them fails if any carries the marker of unreviewed transcriptions, whatever its value."""
    return records.filter(F.when(F.col(marker).isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("a record is not admitted for evaluation")).cast("boolean")))
