import random

import numpy as np
import xxhash

from seqloom.llm import simhash


def brute_print(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
        if w:
            words.append(w)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = list(range(len(rows)))

    def top(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = top(i), top(j)
                ids[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(rows))]


def test_fingerprint_equals_brute_force():
    for t in ["", None, "one", "One two", "a b c", "a b c d a b c", " é Ä x\ty\nz ", "x " * 500, "zero\x0bone\x0ctwo\rthree\x1cfour"]:
        assert simhash.fingerprint(t) == brute_print(t), t


def test_forest_links_connect_what_is_near():
    rng = random.Random(5)
    values, shards = [], []
    for shard in range(40):
        base = rng.getrandbits(64)
        own = {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for _ in range(rng.randrange(1, 40))}
        own |= {rng.getrandbits(64) for _ in range(5)}
        values += sorted(own)
        shards += [shard] * len(own)
    u, v = simhash.forest_links(np.array(shards), np.array(values, dtype=np.uint64), np.ones(len(values), bool))
    assert len(u) < len(values)
    got = simhash.Groups(len(values))
    where = {(s, x): i for i, (s, x) in enumerate(zip(shards, values))}
    by_value = {x: i for i, x in enumerate(values)}
    got.join(np.array([by_value[int(x)] for x in u], dtype=int), np.array([by_value[int(x)] for x in v], dtype=int))
    want = simhash.Groups(len(values))
    for (s, x), i in where.items():
        for (r, y), j in where.items():
            if s == r and (x ^ y).bit_count() <= 3:
                want.join(np.array([i]), np.array([j]))
    assert (got.least == want.least).all()


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_QUERIES", 5)  # so that shards are split here too
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "alone", "alone"]
    for _ in range(12):
        base = rng.choices(words, k=120)
        texts += [" ".join(base)] * 2
        for _ in range(6):
            near = list(base)
            near[rng.randrange(120)] = "edit"
            texts.append(" ".join(near))
    rows = [(i * 7 % 1000, t, "clash") for i, t in enumerate(texts)] + [(None, "alone", "x"), (0, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = simhash.near_duplicates(df).collect()
    prints = [(d, brute_print(t)) for d, t, _ in rows]
    want = sorted((str(d), f, c) for (d, f), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for d, _, c in ((d, f, c) for (d, f), c in zip(prints, brute_components(prints), strict=True)) if d is None or d == c}


def test_hot_fingerprints_take_the_other_way(spark, monkeypatch):
    from seqloom import runtime

    rows = [(i, "the same text for most rows") for i in range(60)] + [(100 + i, f"another text of its own number {i} and more words {i * 7}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(runtime, "HOT_LEAST", 5)
    monkeypatch.setattr(runtime, "HOT_SHARE", 10)
    assert sorted(map(str, simhash.near_duplicates(df).collect())) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.drop_near_duplicates(df).collect() == []
