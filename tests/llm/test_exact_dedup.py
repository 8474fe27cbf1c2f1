import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm import exact_dedup as d
from seqloom.llm import near_text
from seqloom.runtime import Scratch


def rows():
    texts = ["same", "same", None, "", " same", "same", "é", "x" * 100_000, "x" * 100_000] + ["hot"] * 40 + [f"own {i}" for i in range(30)]
    out = [(i * 7 % 101, t, f"k{i}") for i, t in enumerate(texts)]
    return out + [(500, "same", "b"), (500, "same", "a"), (None, "same", "n"), (None, "alone", "n")]


def brute(data):
    groups = defaultdict(list)
    for i, t, _ in data:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((str(i), str(keep), len(ids), kept, digest))
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, keep_id string").repartition(3)


def got(found):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, bytes(r.digest).hex()) for r in found.collect())


def test_equals_brute_force(spark):
    data = rows()
    assert got(d.deduplicate(frame(spark, data))) == brute(data)


def test_hot_groups_take_the_other_way_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_LEAST", 5)
    monkeypatch.setattr(runtime, "HOT_SHARE", 20)
    data = rows()
    assert got(d.deduplicate(frame(spark, data))) == brute(data)


def test_new_data_meets_the_index(spark):
    index = d.DigestIndex(spark, Scratch(spark, "test").path("index"), buckets=3)
    first = frame(spark, [(1, "a", ""), (2, "b", ""), (3, "a", "")])
    assert sorted((r.doc_id, r.kept) for r in d.deduplicate(first, index).collect()) == [(1, False), (2, True), (3, True)]
    second = frame(spark, [(9, "a", ""), (4, "c", ""), (5, "c", "")])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in d.deduplicate(second, index).collect()) == [(4, 5, False), (5, 5, True), (9, 3, False)]
    assert index.table().count() == 3
    again = frame(spark, [(7, "c", "")])
    assert [r.kept for r in d.deduplicate(again, index).collect()] == [False]


def test_a_lost_job_can_run_again(spark):
    index = d.DigestIndex(spark, Scratch(spark, "test").path("index"), buckets=3)
    rows = [(1, "a", ""), (2, "b", ""), (3, "a", "")]
    once = got(d.deduplicate(frame(spark, rows), index))
    assert got(d.deduplicate(frame(spark, rows), index)) == once and sum(r[3] for r in once) == 2
    assert index.table().count() == 2
    named = [(4, "a", ""), (5, "c", "")]
    for _ in range(2):
        assert sorted((r.doc_id, r.keep_id, r.kept) for r in d.deduplicate(frame(spark, named), index, "second").collect()) == [(4, 3, False), (5, 5, True)]
    assert index.table().count() == 3
    index.drop()
    assert not index.exists()


def test_an_index_of_an_earlier_run_is_found_again(spark):
    path = Scratch(spark, "test").path("index")
    d.deduplicate(frame(spark, [(1, "a", "")]), d.DigestIndex(spark, path, "kept_index", buckets=3)).collect()
    later = d.DigestIndex(spark, path, "kept_index")
    assert [r.kept for r in d.deduplicate(frame(spark, [(2, "a", ""), (3, "z", "")]), later).orderBy("doc_id").collect()] == [False, True]
    assert later.buckets == 3
    later.drop()


def test_buckets_grow_with_the_digests(spark, monkeypatch):
    monkeypatch.setattr(d, "BUCKET_ROWS", 5)
    index = d.DigestIndex(spark, Scratch(spark, "test").path("index"))
    d.deduplicate(frame(spark, rows()), index)
    assert index.buckets == -(-len({t or "" for _, t, _ in rows()}) // 5)


def test_index_side_is_not_shuffled(spark):
    index = d.DigestIndex(spark, Scratch(spark, "test").path("index"), buckets=4)
    d.deduplicate(frame(spark, rows()), index)
    batch = d.digests(frame(spark, rows())).groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    plan = index.new_only(batch, "other")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_columns_of_any_type_pass_where_rows_repeat(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, NULL, map('a', 1), 'x'), (1L, '', map('b', 2), 'y'), (1L, '', map('a', 1), 'x'), (2L, 'z', map('c', 3), 'w') AS t(doc_id, text, m, `odd.name`)")
    kept = d.drop_duplicates(df).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, ""), (2, "z")]


def test_filter_keeps_one_of_each(spark):
    data = rows()
    df = frame(spark, data)
    kept = d.drop_duplicates(df)
    assert kept.columns == df.columns
    found = kept.collect()
    assert sorted((str(r.doc_id), r.text or "") for r in found) == sorted((i, t) for i, t in {(k[1], t) for t, k in ((t, x) for x in brute(data) for t in {t or "" for _, t, _ in data} if hashlib.sha256(t.encode()).hexdigest() == x[4])})
    assert [r.keep_id for r in found if r.doc_id == 500] == ["a"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert d.deduplicate(none).collect() == [] and d.drop_duplicates(none).collect() == []


def test_texts_meet_what_goes_in_a_merge_join(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    for filtered in (d.drop_duplicates(docs), near_text.drop_near_copies(docs)):
        plan = filtered._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
