"""Closures, pairings, added confusions and primary members on small cases, wrong ones too."""

import hashlib

import pytest

from seqloom.operators import commitments, selection


def _closure(spark, groups):
    rows = [("x", g, m) for g, members in groups.items() for m in members]
    return selection.closure_report(spark.createDataFrame(rows, "axis string, group string, member string")).first()


def test_closures(spark):
    assert _closure(spark, {"a": "abc", "b": "b", "c": "c"}).valid
    crossing = _closure(spark, {"a": "abc", "d": "bcd"})
    assert crossing.crossing and not crossing.valid
    assert _closure(spark, {"a": "ab", "b": "ab"}).same_members
    assert _closure(spark, {"a": "b", "c": "c"}).self_missing == 1
    assert _closure(spark, {"a": "ab", "b": "abc"}).crossing  # a holds b, but not all that b holds


def test_pairing(spark):
    left, right = (spark.createDataFrame([(k,) for k in keys], "k int") for keys in ([1, 2, 3, 3, None], [1, 3, 4]))
    got = sorted((r.key or 0, r.status) for r in selection.pairing(left, right, "k").collect())
    assert got == [(0, "unidentified"), (1, "paired"), (2, "missing"), (3, "repeated"), (4, "extra")]


def test_added_confusions(spark):
    make = lambda rows: selection.add_confusions(spark.createDataFrame(rows, "truth string, predicted string, mass double"), ["a", "b"])
    got = {(r.truth, r.predicted): r.mass for r in make([("a", "b", 0.1)] * 10 + [("b", "b", 1e9), ("b", "b", 1e-9)]).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 1.0, ("b", "a"): 0.0, ("b", "b"): 1e9 + 1e-9}
    for bad in [("c", "a", 1.0), ("a", "a", -1.0), ("a", "a", float("nan"))]:
        with pytest.raises(Exception, match="unknown state or bad mass"):
            make([bad]).collect()


def test_primary_members(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("h", None)], "group string, member int")
    got = selection.primary_members(rows, "group", "member", 0).collect()
    assert [r.group for r in got] == ["g"] and got[0].member in (1, 2)
    assert selection.representatives(rows, "group", "member").filter("group = 'g'").first().replicas == 3


def test_order_free_digest_by_levels(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    keys = [sha(str(k)) for k in range(300)] + [sha("7")]

    def level(parts, letters):
        groups = {}
        for p, d in sorted(parts):
            groups.setdefault(p[:letters], []).append(d)
        return [(p, sha("".join(ds))) for p, ds in groups.items()]

    rows = spark.createDataFrame([(k,) for k in keys], "d string").repartition(3)
    two = level([(k, k) for k in keys], 3)
    three = level(level([(k, k) for k in keys], 6), 3)
    for most, parts in ((1, two), (0.01, three)):
        got = commitments.order_free_digest(rows, rows["d"], most).first()
        assert (got.digest, got.rows) == (level(parts, 0)[0][1], 301)
    assert commitments.order_free_digest(rows.limit(0), rows["d"]).first().rows == 0
