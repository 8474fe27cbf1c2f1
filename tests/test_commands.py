"""Commands and the ingestion stream on a small nested corpus."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.plans import commands
from seqloom.streaming import ingest
from tests.test_sources import artifact


def make(n, signs, family=None, **changes):
    record = artifact(n, duplicate_family_id=family, images=[], **changes)
    base = record["sides"][0]["lines"][0]["tokens"][0]
    record["sides"][0] |= {"image_ids": []}
    record["sides"][0]["lines"][0]["tokens"] = [base | {"token_id": f"t{k}", "sign_id": s, "visual_index": k, "reading_index": k} for k, s in enumerate(signs)]
    record["catalog_crosswalk"] = [{"catalog": "C", "identifier": str(n), "certainty": 1.0}]
    return record


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("corpus")
    rows = [make(n, [rng.choice("ABCDE") for _ in range(rng.randrange(2, 9))], f"F{n // 3}" if n < 12 else None) for n in range(40)]
    rows[30]["sides"] = rows[31]["sides"]
    out = {}
    for name, own in (("all", rows), ("train", rows[:30]), ("test", rows[30:])):
        out[name] = str(folder / f"{name}.jsonl")
        with open(out[name], "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in own)
    out["folder"] = str(folder)
    return out


def test_validate_and_manifest(spark, paths):
    assert commands.validate(spark, paths["all"]).count() == 0
    row = commands.manifest(spark, paths["all"]).first()
    assert row.artifacts == 40 and row.lines == 40 and row.tokens > 80 and len(row.corpus_sha256) == 64
    assert commands.run(["manifest", paths["all"]]) == 0 and commands.run(["validate", paths["all"]]) == 0


def test_split_is_clean_and_written_once(spark, paths, tmp_path):
    result = commands.split(spark, paths["all"], 0.25, 1)
    sides = {r.artifact_id: r.partition for r in result.rows.select("artifact_id", "partition").collect()}
    assert len(sides) == 40 and sides["a0"] == sides["a1"] == sides["a2"] and sides["a30"] == sides["a31"]
    out = str(tmp_path / "out")
    assert commands.run(["split", paths["all"], out, "--fraction", "0.25", "--seed", "1"]) == 0
    assert commands.audit(spark, f"{out}/train.jsonl", f"{out}/development.jsonl").count() == 0
    assert spark.read.text(f"{out}/train.jsonl").count() + spark.read.text(f"{out}/development.jsonl").count() == 40
    with pytest.raises(Exception, match="(?i)exists"):
        commands.write_split(result, out)


def test_audit_finds_what_both_sides_hold(spark, paths, tmp_path):
    other = str(tmp_path / "x.jsonl")
    with open(paths["train"]) as f, open(other, "w") as g:
        g.write(f.readline().replace('"a0"', '"z"'))
    assert {r.kind for r in commands.audit(spark, paths["train"], other).collect()} >= {"family", "sequence", "catalog_crosswalk"}
    assert commands.run(["audit", paths["train"], other]) == 2


def test_baseline_and_nulls(spark, paths):
    row = commands.baseline(spark, paths["train"], paths["test"]).first()
    assert row.token_count == row.evaluated and 1 < row.perplexity < 20 and 0 < row.mrr <= 1
    summary, p = commands.null_evaluate(spark, paths["train"], paths["test"], 5)
    assert {r.metric for r in summary.collect()} == {"perplexity", "accuracy", "mrr"}
    assert all(1 / 6 <= v <= 1 for v in p.first())


def test_treewidth_and_shuffle(spark, paths):
    widths = commands.treewidth_audit(spark, paths["all"], 3).collect()
    assert sorted((r.family, r.run) for r in widths) == sorted([("observed", -1), *((f, k) for f in ("global_shuffle", "within_sequence", "iid") for k in range(3))])
    assert all(1 <= r.width <= 4 for r in widths)
    before = commands.sign_tokens(commands.corpus(spark, paths["all"]))
    after = commands.control_shuffle(spark, paths["all"], 7)
    count = lambda df: {tuple(r) for r in df.groupBy("sign").agg(F.count("*")).collect()}
    assert count(before) == count(after)


def test_stream_admits_sound_artifacts_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in [make(1, "AB", "F"), make(2, "AB", "F"), make(3, "C", schema_version="9")]))
    for _ in range(2):
        commands_query = ingest.gate(ingest.artifact_stream(spark, str(source)), out, str(tmp_path / "check"))
        assert commands_query.awaitTermination(120)
    assert sorted(r.artifact_id for r in spark.read.parquet(f"{out}/artifacts").collect()) == ["a1", "a2"]
    assert {r.code for r in spark.read.parquet(f"{out}/issues").collect()} == {"unsupported_schema_version"}
    assert {(r.kind, tuple(r.artifacts)) for r in ingest.shared_evidence(spark, out).collect()} == {("family", ("a1", "a2")), ("sequence", ("a1", "a2"))}
