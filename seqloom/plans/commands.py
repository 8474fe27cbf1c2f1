"""Commands as composed plans: from files to tables and one-row reports.

Each takes a session and paths and returns DataFrames; nothing is printed. A gate
that fails raises; run() turns that into an exit code.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import family_key, group_text, image_hash
from seqloom.operators import language_models as lm
from seqloom.operators import leakage, nulls, quarantine, sequences, splits, validation
from seqloom.operators.commitments import order_free_digest
from seqloom.operators.graph import adjacency, treewidth_bounds
from seqloom.runtime import Scratch
from seqloom.sources import artifacts

SEQUENCE = ["artifact_id", "side_no", "line_no", "seg"]


class GateFailed(Exception):
    """A check that stops a command."""


def corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return artifacts.strict_json_lines(spark, path) if strict else artifacts.json_lines(spark, path)


def sign_tokens(records: DataFrame) -> DataFrame:
    """(artifact_id, side_no, line_no, seg, idx, sign, token_key): readable signs in reading order, cut at gaps."""
    slots = sequences.lines(records).select("artifact_id", "side_no", "line_no", F.posexplode("slots").alias("pos", "sign"))
    unit = ["artifact_id", "side_no", "line_no"]
    key = F.concat_ws("/", "artifact_id", F.lpad("side_no", 6, "0"), F.lpad("line_no", 6, "0"), F.lpad("pos", 6, "0"))
    return sequences.segments(slots.withColumn("token_key", key), unit)


def evidence(records: DataFrame) -> DataFrame:
    """(artifact, kind, value) of everything that two records may share."""
    who = F.col("artifact_id").alias("artifact")
    family = records.select(who, F.lit("family").alias("kind"), family_key(F.col("duplicate_family_id"), F.col("artifact_id")).alias("value"))
    images = records.select(who, F.explode("images").alias("m")).select("artifact", F.lit("image_hash").alias("kind"), image_hash(F.col("m.image_hash")).alias("value")).filter("value IS NOT NULL")
    lines = sequences.lines(records).select(F.col("artifact_id").alias("artifact"), F.lit("sequence").alias("kind"), F.to_json(sequences.fingerprint(F.col("slots"))).alias("value")).filter("value IS NOT NULL")
    catalog = records.select(who, F.explode("catalog_crosswalk").alias("c")).filter("trim(c.catalog) <> '' AND trim(c.identifier) <> ''")
    alias = catalog.select("artifact", F.lit("catalog_crosswalk").alias("kind"), F.to_json(F.array(F.trim("c.catalog"), F.trim("c.identifier"))).alias("value"))
    return family.unionByName(images).unionByName(lines).unionByName(alias).distinct()


def validate(spark: SparkSession, path: str) -> DataFrame:
    return validation.validate(corpus(spark, path, strict=True))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Counts over all records and by site, period and object type, with an order-free digest of all rows."""
    records = corpus(spark, path)
    lines = records.select("artifact_id", F.aggregate(F.flatten(F.transform("sides", lambda s: F.transform(s["lines"], lambda x: F.size(x["tokens"])))), F.lit(0), lambda a, n: a + n).alias("tokens"), F.aggregate("sides", F.lit(0), lambda a, s: a + F.size(s["lines"])).alias("lines"))
    total = lines.agg(F.count("*").alias("artifacts"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    groups = None
    for name, value in (("site", group_text(F.col("site.site_id"))), ("period", group_text(F.col("period.phase"), F.col("period.label"))), ("object_type", group_text(F.col("object.object_type")))):
        own = records.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("group"), "value", "n")
        groups = own if groups is None else groups.unionByName(own)
    one = order_free_digest(records, F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256)).select(F.col("digest").alias("corpus_sha256"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("group", "value", "n"))).alias("groups"))
    return total.crossJoin(one).crossJoin(listed)  # three one-row tables


@dataclass
class Split:
    rows: DataFrame
    leakage: DataFrame
    counts: DataFrame


def split(spark: SparkSession, path: str, fraction: float = 0.2, seed: int | str = 0) -> Split:
    """Validate, split by leakage components, and audit the result, which must be clean."""
    scratch = Scratch(spark, "split-command")
    records = corpus(spark, path)
    issues = scratch.keep(validation.validate(records), "issues")
    if validation.has_errors(issues):
        raise GateFailed("the corpus has validation errors")
    held = scratch.keep(evidence(records), "evidence")
    keyed = scratch.keep(splits.component_keys(splits.leakage_components(held, scratch)), "components")
    parts = scratch.keep(splits.group_split(keyed, "component_key", fraction, seed).select(F.col("artifact").alias("artifact_id"), "partition"), "partition")
    found = leakage.report(held.join(parts.withColumnRenamed("artifact_id", "artifact"), "artifact"))
    if not found.isEmpty():
        raise GateFailed("the split leaks")
    rows = records.join(parts, "artifact_id")
    return Split(rows, found, parts.groupBy("partition").agg(F.count("*").alias("artifacts")))


def write_split(result: Split, folder: str) -> None:
    """train, development and the report beside each other; nothing is replaced."""
    for side, name in (("train", "train"), ("test", "development")):
        artifacts.write_json_lines(result.rows.filter(F.col("partition") == side).drop("partition"), f"{folder}/{name}.jsonl", ["artifact_id"])
    artifacts.write_json_lines(result.counts, f"{folder}/split-manifest.jsonl", ["partition"])
    artifacts.write_json_lines(result.leakage, f"{folder}/leakage-audit.jsonl", ["kind"])


def audit(spark: SparkSession, train: str, test: str) -> DataFrame:
    sides = [evidence(corpus(spark, p)).withColumn("partition", F.lit(n)) for p, n in ((train, "train"), (test, "test"))]
    return leakage.overlaps(sides[0].unionByName(sides[1]))


def baseline(spark: SparkSession, train: str, test: str, order: int = 2) -> DataFrame:
    """One row: held-out likelihood and, for bigrams, masked-sign scores."""
    fit, held = (sign_tokens(corpus(spark, p)) for p in (train, test))
    model = lm.add_one(lm.contexts(fit, SEQUENCE, order))
    known = lm.contexts(lm.known_signs(held, model[0]), SEQUENCE, order)
    scores = lm.heldout_score(lm.token_probabilities(known, model))
    if order != 2:
        return scores
    return scores.crossJoin(lm.masked_score(lm.masked_ranks(held, model, SEQUENCE)))  # one row each


def control_shuffle(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Readable signs moved among all readable places of the corpus."""
    return nulls.shuffle_signs(nulls.with_runs(sign_tokens(corpus(spark, path)), 1, seed), "token_key", ["run"]).drop("run")


def null_evaluate(spark: SparkSession, train: str, test: str, runs: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Summaries of the null runs by metric, and one row of empirical p-values."""
    scratch = Scratch(spark, "null-command")
    cut = None
    for path, name in ((train, "train"), (test, "test")):
        own = sign_tokens(corpus(spark, path)).withColumn("partition", F.lit(name))
        cut = own if cut is None else cut.unionByName(own)
    cut = scratch.keep(cut.withColumn("token_key", F.concat_ws("/", "partition", "token_key")), "tokens")
    moved = nulls.shuffle_signs(nulls.with_runs(cut, runs, seed), "token_key", ["run", "partition"], scratch)
    every = scratch.keep(cut.withColumn("run", F.lit(-1).cast("bigint")).unionByName(moved.select(*cut.columns, "run")), "runs")
    sequence = ["run", "partition", *SEQUENCE]
    fit, held = every.filter("partition = 'train'"), every.filter("partition = 'test'")
    model = tuple(scratch.keep(x, "model") for x in lm.add_one(lm.contexts(fit, sequence, 2), ["run"]))
    known = lm.contexts(lm.known_signs(held, model[0], ["run"]), sequence, 2)
    a = lm.heldout_score(lm.token_probabilities(known, model, ["run"]), ["run"]).select("run", "perplexity")
    b = lm.masked_score(lm.masked_ranks(held, model, sequence, ["run"]), ["run"]).select("run", "accuracy", "mrr")
    scores = scratch.keep(a.join(b, "run"), "scores")
    summary = nulls.summary(scores.filter("run >= 0").unpivot("run", ["perplexity", "accuracy", "mrr"], "metric", "value"), "value", ["metric"])
    observed = scores.filter("run = -1").select(*(F.col(c).alias(f"o_{c}") for c in ("perplexity", "accuracy", "mrr")))
    p = scores.filter("run >= 0").crossJoin(F.broadcast(observed)).agg(*(nulls.empirical_p(F.col(c), F.col(f"o_{c}"), c != "perplexity").alias(f"p_{c}") for c in ("perplexity", "accuracy", "mrr")))  # one row
    return summary, p


def treewidth_audit(spark: SparkSession, path: str, runs: int = 100, least: int = 1) -> DataFrame:
    """Widths of the observed graph (run -1) and of three null families, by family and run."""
    scratch = Scratch(spark, "treewidth-command")
    tokens = sign_tokens(corpus(spark, path))
    sizes = tokens.groupBy(*SEQUENCE).agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")
    tokens = scratch.keep(tokens.join(sizes, SEQUENCE, "left_semi"), "tokens")
    many = nulls.with_runs(tokens, runs)
    families = {
        "observed": tokens.withColumn("run", F.lit(-1).cast("bigint")), "global_shuffle": nulls.shuffle_signs(many, "token_key", ["run"], scratch),
        "within_sequence": nulls.shuffle_within(many, "token_key", SEQUENCE), "iid": nulls.draw_iid(many, "token_key"),
    }
    out = None
    for name, rows in families.items():
        own = rows.select("run", *SEQUENCE, "idx", "sign").withColumn("family", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return treewidth_bounds(adjacency(out, ["family", "run", *SEQUENCE], ["family", "run"])[1], ["family", "run"])


def quarantine_gate(spark: SparkSession, path: str, registry: DataFrame, rules: DataFrame, purpose: str) -> DataFrame:
    """Findings over all source references of a corpus."""
    records = corpus(spark, path)
    sources = records.select("artifact_id", F.explode("source_records").alias("s")).select("artifact_id", "s.source_id", "s.locator", "s.revision")
    images = records.select("artifact_id", F.explode("images").alias("m")).select("artifact_id", "m.source_id", F.col("m.uri").alias("locator"), F.lit(None).cast("string").alias("revision"))
    return quarantine.inspect(sources.unionByName(images), artifacts.registry(registry), rules, purpose)


def run(argv: list[str] | None = None) -> int:
    """Command line: 0 for success, 2 for a failed gate."""
    parser = argparse.ArgumentParser(prog="seqloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, paths in (("validate", ["corpus"]), ("manifest", ["corpus"]), ("split", ["corpus", "out"]), ("audit", ["train", "test"]), ("baseline", ["train", "test"]), ("null-evaluate", ["train", "test"]), ("treewidth-audit", ["corpus"]), ("control-shuffle", ["corpus", "out"])):
        p = sub.add_parser(name)
        for path in paths:
            p.add_argument(path)
        p.add_argument("--seed", default=0, type=int)
        p.add_argument("--fraction", default=0.2, type=float)
        p.add_argument("--runs", default=100, type=int)
        p.add_argument("--order", default=2, type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("seqloom").getOrCreate()

    def show(rows: DataFrame) -> None:
        """All rows, a partition at a time."""
        for line in rows.toJSON().toLocalIterator():
            print(line)

    try:
        if a.command == "validate":
            issues = Scratch(spark, "validate-command").keep(validate(spark, a.corpus), "issues")
            show(issues.orderBy("artifact_id", "path", "code"))
            return 2 if validation.has_errors(issues) else 0
        if a.command == "manifest":
            print(artifacts.report(manifest(spark, a.corpus)), end="")
        elif a.command == "split":
            write_split(split(spark, a.corpus, a.fraction, a.seed), a.out)
        elif a.command == "audit":
            found = audit(spark, a.train, a.test)
            show(found.orderBy("kind", "value"))
            return 0 if found.isEmpty() else 2
        elif a.command == "baseline":
            print(artifacts.report(baseline(spark, a.train, a.test, a.order)), end="")
        elif a.command == "null-evaluate":
            summary, p = null_evaluate(spark, a.train, a.test, a.runs, a.seed)
            show(summary.orderBy("metric"))
            print(artifacts.report(p), end="")
        elif a.command == "treewidth-audit":
            show(treewidth_audit(spark, a.corpus, a.runs).orderBy("family", "run"))
        else:
            artifacts.write_json_lines(control_shuffle(spark, a.corpus, a.seed), a.out, ["token_key"])
    except GateFailed as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(run())
