import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import lm_scoring as lm
from seqloom.llm.elias_fano import EliasFano, Level, TrieShard


def brute(docs):
    """The contract's base and the documented trigram model, by dictionaries over the full vocabulary."""
    cut = lambda t: re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [""]
    held = [zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1 for d, _ in docs]
    own = [cut(t) for _, t in docs]
    train = [ws for h, ws in zip(held, own) if not h]
    c = Counter(w for ws in train for w in ws)
    n, mass = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    two = Counter(p for ws in train for p in zip(["", *ws], ws))
    three = Counter(p for ws in train for p in zip(["", *ws], ws, ws[1:]))
    totals, kinds = Counter(), Counter()
    for grams in (two, three):
        for gram, k in grams.items():
            totals[gram[:-1]] += k
            kinds[gram[:-1]] += 1

    def p(gram):
        if len(gram) == 1:
            return (c[gram[0]] + 0.5) / mass
        context, lower = gram[:-1], p(gram[1:])
        if not totals[context]:
            return lower
        seen = (two if len(gram) == 2 else three)[gram]
        return max(seen - lm.DISCOUNT, 0) / totals[context] + lm.DISCOUNT * kinds[context] / totals[context] * lower

    out = []
    for (d, _), h, ws in zip(docs, held, own):
        past = ["", *ws]
        s = math.log10(p(("", ws[0]))) + sum(math.log10(p((past[k - 1], past[k], ws[k]))) for k in range(1, len(ws)))
        out.append((str(d), h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(p((w,))) for w in ws), s))
    return sorted(out)


@pytest.mark.parametrize("uses,split,flush", [(2_000_000, 500_000, 600_000), (300, 60, 200), (40, 9, 40)])
def test_scores_equal_brute_force(spark, monkeypatch, uses, split, flush):
    monkeypatch.setattr(lm, "SHARD_USES", uses)
    monkeypatch.setattr(lm, "SPLIT", split)
    monkeypatch.setattr(lm, "FLUSH_TOKENS", flush)
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(90)] + ["É", "x\x1cy"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(120)] + [(500, None), (501, ""), (None, "W1 w2\tw3\x0b\nw1"), (3, "w1"), (3, "w1")]
    docs += [(i, "a b " * 20 + f"a b c{i}") for i in range(600, 620)] + [(700, "long " * 3000)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, score double").repartition(3)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df).collect())
    want = brute(docs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-9)
    assert all(abs(g[6] - w[6]) <= 1.5 * g[2] / lm.QUANTUM for g, w in zip(got, want))


def test_hot_words_and_bigrams_are_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_USES", 100)
    monkeypatch.setattr(lm, "SPLIT", 20)
    seen = {}
    keep = lm.split_totals
    monkeypatch.setattr(lm, "split_totals", lambda plan, tries: seen.setdefault("totals", (plan, keep(plan, tries)))[1])
    docs = [(i, " ".join(f"a b c{i * 7 + k}" for k in range(6))) for i in range(40)]
    got = sorted((str(r.doc_id), r.score) for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    plan, totals = seen["totals"]
    assert len(plan.words) >= 3 and len(plan.pair1) >= 1 and plan.pair_parts.max() > 1
    held = sum(zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs)
    assert totals.pair_n.max() == 6 * (40 - held) and totals.pair_kinds.max() == 6 * (40 - held)
    assert all(abs(g - w[6]) <= 1.5 * w[2] / lm.QUANTUM for (_, g), w in zip(got, brute(docs)))


def test_elias_fano_finds_what_is_there():
    rng = random.Random(1)
    for top in (1, 10, 300, 10**5, 2**40, 2**60):
        values = np.array(sorted({rng.randrange(top) for _ in range(min(top, 400))}), dtype=np.uint64)
        ef = EliasFano(EliasFano.build(values))
        assert (ef.find(values) == np.arange(len(values))).all() and (ef.at(np.arange(len(values))) == values).all()
        asked = np.array([rng.randrange(top + 5) for _ in range(3000)] + [2**63], dtype=np.uint64)
        there = {int(v): k for k, v in enumerate(values)}
        assert ef.find(asked).tolist() == [there.get(int(a), -1) for a in asked]
    flat = np.array([0, 0, 0, 3, 3, 9, 9, 200], dtype=np.uint64)
    assert (EliasFano(EliasFano.build(flat)).at(np.arange(8)) == flat).all()
    none = EliasFano(EliasFano.build(np.zeros(0, np.uint64)))
    assert none.find(np.array([0, 5], np.uint64)).tolist() == [-1, -1]


def test_successors_are_searched_between_two_pointers():
    rng = np.random.default_rng(3)
    starts = np.r_[0, np.cumsum(rng.integers(0, 4, 1000))]
    successors = np.concatenate([np.sort(rng.choice(50, k, replace=False)) for k in np.diff(starts)])
    level = Level(Level.build(starts, successors))
    there = {(c, int(s)): k for c in range(1000) for k, s in zip(range(starts[c], starts[c + 1]), successors[starts[c] : starts[c + 1]])}
    c, s = rng.integers(0, 1000, 20000), rng.integers(0, 60, 20000)
    assert level.find(c, s).tolist() == [there.get((a, int(b)), -1) for a, b in zip(c, s)]


def test_a_mapped_shard_answers_like_one_in_memory(tmp_path, spark):
    docs = spark.createDataFrame([(k, "a b c a b d") for k in range(9)], "doc_id long, text string")
    content = [bytes(r.a) for r in lm.fit_and_score(docs).trie.collect()][0]
    (tmp_path / "shard").write_bytes(content)
    one, two = TrieShard(content), TrieShard.map(str(tmp_path / "shard"))
    x = one.contexts.at(np.arange(one.contexts.n))
    for shard in (one, two):
        pairs = [shard.pairs(np.full(len(x), c, np.uint64), x) for c in x]
        assert all((a == b).all() for p, q in zip(pairs, [one.pairs(np.full(len(x), c, np.uint64), x) for c in x]) for a, b in zip(p, q))
        assert sum(int((p[2] > 0).sum()) for p in pairs) == one.level2.values.n
        assert sum(int((shard.triples(np.full(len(x), k), x) > 0).sum()) for k in range(one.level2.values.n)) == one.level3.values.n


def test_squeezed_numbers_come_back():
    for values in ([], [0], [5, 300, 2**63], list(range(1000))):
        a = np.array(values, dtype=np.uint64)
        assert (lm.unsqueeze(lm.squeeze(a)) == a).all() and (lm.unrising(lm.rising(a)) == a).all()
    assert lm.unbundle(lm.bundle(b"", b"abc", b"d")) == [b"", b"abc", b"d"]


def test_empty_tables_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(none).collect() == []
    held = [d for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    got = lm.score(spark.createDataFrame([(d, "a b") for d in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] * 2 and all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-9 for r in got)
