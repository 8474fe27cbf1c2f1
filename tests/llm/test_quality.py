import math
import random

import numpy as np

from seqloom.llm import quality

RUDE = ["oaf", "dunce", "knave", "lout"]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "sen", "dor", "vil", "mu")]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocabulary, k=rng.randrange(20, 200))
        kind = rng.choice(["fine"] * 7 + ["rude", "shout", "noise"])
        if kind == "rude":
            for _ in range(rng.randrange(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        text = " ".join(w)
        text = text.upper() if kind == "shout" else text.replace(" ", "%%% ") if kind == "noise" else text
        docs.append((i, text, f"s{i % 7}", "en", len(text), kind))
        if rng.random() < 0.7:
            labels.append((i, int(kind in ("fine", "rude")), int(kind == "rude")))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long, kept string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    df, lab = frames(spark, docs, labels)
    got = {r.doc_id: r.kept for r in quality.classify(df, lab).collect()}
    assert len(got) == len(docs)
    unseen = {d[0]: d[5] for d in docs} | {}
    for i, *_ in labels:
        unseen.pop(i)
    right = [got[i] == (kind == "fine") for i, kind in unseen.items()]
    assert np.mean(right) > 0.95
    assert np.mean([got[i] for i, kind in unseen.items() if kind == "fine"]) > 0.97
    kept = quality.drop_rejected(df, lab)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_driver_scores_equal_a_plain_sum(spark):
    docs, labels = corpus(300)
    df, lab = frames(spark, docs, labels)
    model = quality.fit(df, lab)
    judge, at = model.scorer(), {w: k for k, w in enumerate(model.vocabulary)}
    for _, text, source, lang, n, _ in docs[:40]:
        x, m = quality.unpacked([quality.packed(text, source, lang, n, at)], len(at))
        both = model.both[0] * model.views[0].logit(x)[0] + model.both[1] * model.views[1].logit(m)[0] + model.both[2]
        assert abs(judge(text, source, lang, n)[2] - quality.sigmoid(np.array([both]))[0]) < 1e-5


class PlainPool:
    """The documented choice by sorting everything."""

    def __init__(self, rows, known):
        self.rows, self.known = sorted(set(rows)), known

    def surest(self, views, wanted, share):
        tie, out = self.ties, []
        for v in (0, 1):
            z = views[v].logit(quality.unpacked(self.rows, self.known)[v].astype(np.float64))
            rows, labels, lifts = [], [], []
            for label in (0, 1):
                s = z if label else -z
                for k in sorted(range(len(z)), key=lambda k: (-s[k], tie[self.rows[k]], self.rows[k]))[: wanted[label]]:
                    base = share if label else 1 - share
                    lift = (1 / (1 + math.exp(-s[k])) - base) / (1 - base)
                    if lift >= quality.LIFT:
                        rows.append(self.rows[k])
                        labels.append(float(label))
                        lifts.append(lift)
            out.append((rows, np.array(labels), np.array(lifts)))
        return out


def test_co_training_equals_brute_force_and_goes_both_ways(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "PSEUDO", 40)
    docs, labels = corpus(900, 3)
    df, lab = frames(spark, docs, labels)
    model = quality.fit(df, lab)
    assert len(model.given) == quality.ROUNDS and all(a > 0 and b > 0 for a, b in model.given)
    good = {}
    for i, q, t in labels:
        good[i] = min(good.get(i, 1), int(q > 0 and not t))
    at = {w: k for k, w in enumerate(model.vocabulary)}
    packed = {d[0]: quality.packed(*d[1:5], at) for d in docs}
    pool = PlainPool([x for i, x in packed.items() if i not in good], len(at))
    pool.ties = {bytes(r.x): r.tie for r in spark.createDataFrame([(bytearray(x),) for x in pool.rows], "x binary").select("x", F.xxhash64("x").alias("tie")).collect()}
    ids = sorted(good)
    want = quality.co_train(*quality.unpacked([packed[i] for i in ids], len(at)), np.array([float(good[i]) for i in ids]), pool, model.vocabulary)
    assert want.given == model.given
    for a, b in zip(model.views, want.views, strict=True):
        assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.calibrated, b.calibrated, atol=1e-6)
    assert np.allclose(model.both, want.both, atol=1e-6)


def test_fitted_weights_are_where_the_slope_is_zero():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0.3).astype(float)
    weight = rng.uniform(0.2, 1, 300)
    w = quality.fit_logistic(x, np.arange(300), y, weight, 0.7, steps=50)
    loss = lambda w: sum(k * (math.log1p(math.exp(-t)) + (1 - v) * t) for k, v, t in zip(weight, y, x @ w[:-1] + w[-1])) + 0.35 * (w[:-1] ** 2).sum()
    for k in range(5):
        for step in (-1e-3, 1e-3):
            other = w.copy()
            other[k] += step
            assert loss(other) > loss(w) - 1e-9


def test_one_id_repeated_and_a_very_long_text(spark):
    docs, labels = corpus(200, 2)
    docs += [(7, f"copy {k} lo mi", "s1", "en", 12, "fine") for k in range(400)] + [(9001, "ka " * 150_000, "s1", "en", 450_000, "fine")]
    df, lab = frames(spark, docs, labels)
    got = quality.classify(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    from seqloom.runtime import Scratch

    scratch = Scratch(spark, "test")
    rows = quality.sample(df, quality.judgements(lab, scratch), scratch)
    assert rows.count() == len({i for i, *_ in labels})


def test_nulls_missing_columns_and_no_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None), (None, "x"), (1, None)], "doc_id long, text string")
    assert [r.score for r in quality.classify(df, lab).collect()] == [1.0] * 3
    assert quality.drop_rejected(df, lab).count() == 3
    docs, labels = corpus(300)
    full, lab = frames(spark, docs, [*labels, (None, 0, 0), (3, None, None), (5, 1, None), (5, 0, 1)])
    odd = full.select("doc_id", "text").unionByName(df)
    assert quality.classify(odd, lab).count() == 303
    assert quality.classify(odd.limit(0), lab).collect() == []
