import random

import pytest

import corpus_pipeline
from seqloom.llm import near_text, simhash
from seqloom.runtime import Scratch


@pytest.mark.parametrize("part", [2000, 4])
def test_the_stage_drops_what_is_four_fifths_alike(spark, monkeypatch, part):
    monkeypatch.setattr(near_text, "PART", part)
    rng = random.Random(3)
    docs = [(1000, None), (1001, " "), (1002, "a b"), (1003, "A\nb"), (None, "a b")]
    for i in range(0, 200, 2):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 300))]
        other = list(words)
        for _ in range(rng.randrange(1, 8)):
            other[rng.randrange(len(other))] = "new"
        docs += [(i, " ".join(words)), (i + 1, " ".join(other))]
    words = [f"v{rng.randrange(300)}" for _ in range(150)]
    for i in range(2000, 2040):  # one large group whose members are up to twice as far from each other as from its middle
        other = list(words)
        for _ in range(rng.randrange(5)):
            other[rng.randrange(len(other))] = f"n{i}"
        docs.append((i, " ".join(other)))
    docs += [(2050, docs[-1][1]), (2051, docs[-1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    grams = {}
    for k, (_, t) in enumerate(docs):
        w = (t or "").lower().split()
        grams[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    least = list(range(len(docs)))
    for _ in range(4):
        for a in grams:
            for b in grams:
                if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                    least[a] = least[b] = min(least[a], least[b], key=lambda k: (docs[k][0] is None, docs[k][0]))
    want = sorted(str(d) for k, (d, _) in enumerate(docs) if d is None or docs[least[k]][0] == d)
    got = sorted(str(r.doc_id) for r in corpus_pipeline.near_filter(spark, df, "").collect())
    assert got == want and 120 < len(got) < 190


def test_trees_over_fingerprints_give_candidates(spark):
    rng = random.Random(5)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 400))]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words[:-1], "else", "than"])]
    prints = [simhash.of_hashes(near_text.shingle_hashes(t)) for t in texts]
    assert prints == [simhash.fingerprint(t, near_text.SHINGLE) for t in texts]
    least = list(range(len(prints)))
    for _ in range(3):
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a] = least[b] = min(least[a], least[b])
    rows = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "text_hash long, fp long").repartition(3)
    got = {}
    for r in near_text.tree_buckets(rows, Scratch(spark, "trees-test")).collect():
        got.setdefault(r.bucket, set()).add(r.text_hash)
    want = {}
    for k, c in enumerate(least):
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(prints) - 50
