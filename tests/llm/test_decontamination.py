import hashlib
import random
import re

from seqloom.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, window=13):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    cut = {}
    for name, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            cut.setdefault(tuple(w[k : k + window]), set()).add(str(name))
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for p, names in cut.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= names
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x9", "中文"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(15)]
    items += [(15, None), (16, ""), (17, "... !"), (0, items[0][1]), (18, items[5][1].upper())]
    docs = [(0, None), (1, ""), (2, "?!")]
    for i in range(3, 40):
        w = rng.choices(vocabulary, k=rng.choice([5, 60, 300]))
        if i % 2:
            w[2:2] = (items[rng.randrange(15)][1]).split()
        docs.append((i, ("-" if i % 3 else "\n").join(w)))
    return docs + docs[3:5], items


def run(spark, docs, items):
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contamination(df, bench)
    return df, bench, sorted(tuple(r)[:6] for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_equals_brute_force(spark):
    docs, items = cases()
    df, bench, got = run(spark, docs, items)
    assert got == sorted(brute(docs, items))
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_many_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_CHARS", 700)
    docs, items = cases()
    assert run(spark, docs, items)[2] == sorted(brute(docs, items))


def test_spans_lie_in_the_original_text(spark):
    item = "One two, THREE four five six seven eight nine ten eleven twelve thirteen"
    text = "Before it: one TWO three; four five six seven eight nine ten eleven twelve thirteen! After"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = d.contamination(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    a, b = map(int, row.spans.split(":"))
    assert text[a:b].startswith("one TWO") and text[a:b].endswith("thirteen") and row["items"] == ["7"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(none, bench).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.n_hit for r in d.contamination(one, bench).collect()] == [0]
