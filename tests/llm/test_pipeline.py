"""The pipeline's stages against brute force on a small corpus, and as a whole."""

import random

import pytest

import corpus_pipeline
from seqloom.llm import simhash


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "sen", "dor", "vil", "mu", "pel")]
    docs, labels = [], []
    item = " ".join(rng.choices(words, k=30))
    for i in range(420):
        w = rng.choices(words, k=rng.randrange(40, 160))
        kind = "rude" if i % 10 == 3 else "noise" if i % 10 == 7 else "fine"
        if kind == "rude":
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["oaf", "dunce", "knave"]))
        text = "%%% ".join(w) if kind == "noise" else " ".join(w)
        docs.append([i, text, "en", f"s{i % 5}", len(text)])
        if i % 4:
            labels.append((i, int(kind != "noise"), int(kind == "rude")))
    for i in range(0, 60, 10):
        docs.append([1000 + i, docs[i][1], "en", "copy", 0])  # exact copies, the larger id stays
        docs[i + 1][1] = docs[i + 1][1] + " " + item if i < 30 else docs[i + 1][1]  # contaminated
    docs.append([2000, None, None, None, None])
    path = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_does_its_part(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    start, good, exact, near, clean = seen
    fine = {i for i in start if i < 1000 and i % 10 not in (3, 7)}
    assert len(fine - good.keys()) <= 0.03 * len(fine)
    assert len({i for i in good if i < 1000 and i % 10 in (3, 7)}) <= 0.05 * 84
    by_text = {}
    for i, t in good.items():
        by_text[t or ""] = max(i, by_text.get(t or "", -1))
    assert exact.keys() == set(by_text.values())
    prints = {i: simhash.fingerprint(t) for i, t in exact.items()}
    for i in exact.keys() - near.keys():
        assert any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in prints)
    assert {i for i in (1, 11, 21) if i in near}.isdisjoint(clean) and near.keys() - clean.keys() <= {1, 11, 21}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == clean.keys()


def test_run_gives_what_the_stages_give(spark, sf_dir):
    whole = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset"} <= set(whole.columns) and whole.count() > 100
