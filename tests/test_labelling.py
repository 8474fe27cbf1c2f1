"""Decoding, metrics, folds, exact statistics and matching against brute force."""

import itertools
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seqloom.functions import exact, hashing
from seqloom.operators import labelling, matching, metadata, quarantine, rank_statistics, reviews


def test_viterbi_equals_all_paths(spark):
    rng = random.Random(1)
    for _ in range(6):
        n, s = rng.randrange(1, 6), 3
        e = [[round(rng.uniform(-3, 0), 2) for _ in range(s)] for _ in range(n)]
        t = [[round(rng.uniform(-2, 0), 2) for _ in range(s)] for _ in range(s)]
        start = [round(rng.uniform(-2, 0), 2) for _ in range(s)]
        lit = lambda x: F.array(*(F.lit(float(v)) for v in x))
        got = spark.range(1).select(labelling.viterbi(F.array(*map(lit, e)), lit(start), F.array(*map(lit, t)), 0.5, s).alias("p")).first().p
        score = lambda p: e[0][p[0]] + 0.5 * start[p[0]] + sum(e[k][p[k]] + 0.5 * t[p[k - 1]][p[k]] for k in range(1, n))
        assert math.isclose(score(got), max(map(score, itertools.product(range(s), repeat=n))), abs_tol=1e-9)


def test_viterbi_ties_keep_the_first_state(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert spark.range(1).select(labelling.viterbi(F.array(zero, zero, zero), zero, F.array(zero, zero), 1.0, 2).alias("p")).first().p == [0, 0, 0]


def test_metrics_of_a_known_matrix(spark):
    rows = spark.createDataFrame([("a", "a", 2.0), ("a", "b", 1.0), ("b", "b", 1.0)], "truth string, predicted string, weight double")
    matrix = labelling.confusion(rows.union(rows))
    got = {r["class"]: r for r in labelling.class_metrics(matrix, ["a", "b", "c"]).collect()}
    assert math.isclose(got["a"].recall, 2 / 3) and got["a"].precision == 1.0 and got["c"].recall is None and got["c"].f1 == 0.0
    assert labelling.summary_metrics(labelling.class_metrics(matrix, ["a", "b", "c"])).first().macro_f1 is None
    two = labelling.summary_metrics(labelling.class_metrics(matrix, ["a", "b"])).first()
    assert math.isclose(two.accuracy, 0.75) and math.isclose(two.macro_f1, (0.8 + 2 / 3) / 2)


def test_folds_cover_families_and_keep_support(spark):
    rng = random.Random(2)
    names = ["x", "y", "z"]
    rows = [(f"f{i}", *(rng.choice([0, 1, 2, 5]) for _ in names)) for i in range(40)]
    df = spark.createDataFrame(rows, "family string, x long, y long, z long")
    got = {r.family: r.fold for r in labelling.greedy_folds(df, "family", names, 4).collect()}
    assert got.keys() == {r[0] for r in rows}
    for fold in range(4):
        for k in range(3):
            assert sum(r[1 + k] for r in rows if got[r[0]] == fold) > 0
    again = {r.family: r.fold for r in labelling.greedy_folds(df.repartition(5), "family", names, 4).collect()}
    assert got == again


def test_one_standard_error_prefers_the_simple(spark):
    rows = [("big", 9, f, 0.80 + 0.02 * (f % 2)) for f in range(4)] + [("small", 1, f, 0.805) for f in range(4)] + [("bad", 0, f, 0.2) for f in range(4)]
    assert labelling.one_standard_error(spark.createDataFrame(rows, "candidate string, complexity int, fold int, score double")).first().candidate == "small"


def test_degradation_is_nested_and_windows_hold(spark):
    rows = [(f"d{d}", f"l{n}", p, "f") for d in range(20) for n in range(3) for p in range(1, 12)]
    df = spark.createDataFrame(rows, "doc string, line string, pos int, form string")
    kept = {}
    for regime, longest in (("clean", 11), ("mild", 7), ("harsh", 4)):
        got = labelling.degrade(df, "doc", "line", regime).collect()
        kept[regime] = {(r.doc, r.line, r.pos) for r in got}
        for key in {(r.doc, r.line, r.replica) for r in got}:
            own = sorted((r.visual_index, r.pos) for r in got if (r.doc, r.line, r.replica) == key)
            assert len(own) == longest and [v for v, _ in own] == list(range(longest))
            positions = [p for _, p in own]
            assert sorted(positions) == list(range(min(positions), max(positions) + 1)) and positions in (sorted(positions), sorted(positions, reverse=True))
    assert kept["harsh"] <= kept["mild"] <= kept["clean"]


def test_midranks_and_spearman(spark):
    values = [3, 1, 3, 2, 3, 1]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    got = {r.id: r.r for r in rank_statistics.doubled_midranks(df, "v", "r").collect()}
    assert got == {0: 10, 1: 3, 2: 10, 3: 6, 4: 10, 5: 3}
    both = rank_statistics.doubled_midranks(df, "v", "a").withColumn("b", F.col("a"))
    state = rank_statistics.spearman_state(both, "a", "b").first()
    assert state.status == "defined" and state.covariance == state.variance_left == state.variance_right
    flat = rank_statistics.spearman_state(both.withColumn("b", F.lit(1)), "a", "b").first()
    assert flat.status == "undefined_zero_variance_right"


def test_exact_roots():
    rng = random.Random(3)
    for _ in range(300):
        c, r, a, b = rng.randint(-(10**20), 10**20), rng.randint(1, 10**40), rng.randint(-5, 5), rng.randint(1, 9)
        x = Fraction(c * abs(c), r) - Fraction(a * abs(a), b * b)
        assert exact.compare_root(c, r, a, b) == (x > 0) - (x < 0)
    assert exact.round_root(1, 4) == 5 * 10**11 and exact.round_root(-1, 1) == -(10**12) and exact.round_root(1, 2) == 707106781187 and exact.round_root(0, 5) == 0


def test_gcd_and_hmac_are_built_in(spark):
    import hashlib
    import hmac

    rng = random.Random(5)
    pairs = [(rng.randrange(-(10**15), 10**15), rng.randrange(10**15)) for _ in range(50)] + [(0, 0), (0, 5), (1134903170, 701408733)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", exact.greatest_common_divisor(F.col("a"), F.col("b")).alias("g"))
    assert all(r.g == math.gcd(r.a, r.b) for r in df.collect())
    got = spark.createDataFrame([("message",)], "m string").select(*(hashing.hmac_sha256(k, F.col("m")).alias(f"h{i}") for i, k in enumerate((b"key", b"k" * 100)))).first()
    assert list(got) == [hmac.new(k, b"message", hashlib.sha256).hexdigest() for k in (b"key", b"k" * 100)]
    framed = spark.createDataFrame([("ab", 7)], "s string, n long").select(hashing.framed_digest(b"d\0", hashing.frame(F.col("s")), hashing.u64(F.col("n"))).alias("h")).first().h
    assert framed == hashlib.sha256(b"d\0" + (2).to_bytes(8, "big") + b"ab" + (7).to_bytes(8, "big")).hexdigest()


def _all_matchings(anchors, spans):
    best, found = 0, set()
    options = [(i, j) for i, a in enumerate(anchors) for j, (x, y) in enumerate(spans) if x <= a < y]
    for n in range(len(anchors), -1, -1):
        for pick in itertools.combinations(options, n):
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pick, pick[1:])):
                found.add(pick)
        if found:
            best = n
            break
    return best, len(found)


def test_ordered_matchings_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        anchors = sorted(rng.randrange(12) for _ in range(rng.randrange(4)))
        spans = sorted((a, a + rng.randrange(1, 6)) for a in (rng.randrange(12) for _ in range(rng.randrange(4))))
        size, ways, pairs = matching.ordered_matchings(anchors, spans)
        best, count = _all_matchings(anchors, spans)
        assert size == best == len(pairs) and (ways > 1) == (count > 1)


def _matchings_by_table(anchors, spans):
    """Size and number (up to 2) of largest matchings by the table over anchors and spans."""
    n, m = len(anchors), len(spans)
    size = [[0] * (m + 1) for _ in range(n + 1)]
    ways = [[1] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            takes = [k for k in range(j, m) if spans[k][0] <= anchors[i] < spans[k][1]]
            size[i][j] = max([size[i + 1][j], *(1 + size[i + 1][k + 1] for k in takes)])
            if size[i][j]:
                ways[i][j] = min(2, (size[i + 1][j] == size[i][j]) * ways[i + 1][j] + sum(ways[i + 1][k + 1] for k in takes if 1 + size[i + 1][k + 1] == size[i][j]))
    return size[0][0], ways[0][0]


@pytest.mark.parametrize("held", [1 << 20, 5])
def test_ordered_matchings_equal_the_table(monkeypatch, held):
    monkeypatch.setattr(matching, "HELD", held)
    rng = random.Random(11)
    for k in range(300):
        wide = rng.choice((15, 60, 400))
        anchors = sorted(rng.randrange(wide) for _ in range(rng.randrange(25)))
        spans = sorted((a, a + rng.randrange(1, rng.choice((3, 20)))) for a in (rng.randrange(wide) for _ in range(rng.randrange(25))))
        size, ways, pairs = matching.ordered_matchings(anchors, spans)
        assert (size, min(ways, 2)) == _matchings_by_table(anchors, spans) and len(pairs) == size
        assert all(spans[j][0] <= anchors[i] < spans[j][1] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_ordered_matchings_of_a_long_lane():
    rng = random.Random(12)
    anchors = sorted(rng.randrange(86400) for _ in range(4000))
    spans = sorted((a, a + rng.randrange(1, 6000)) for a in (rng.randrange(86400) for _ in range(4000)))
    began = time.process_time()
    assert 3000 < matching.ordered_matchings(anchors, spans)[0] <= 4000
    assert time.process_time() - began < 20  # 16 million cells in Python take longer


def test_monotone_alignment_is_lexicographic():
    rng = random.Random(7)
    for _ in range(200):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        overlap = [[rng.choice([0.0, 0.3, 0.6, 0.9]) for _ in range(m)] for _ in range(n)]
        options = [(i, j) for i in range(n) for j in range(m) if overlap[i][j] >= 0.5]
        every = [p for k in range(4) for p in itertools.combinations(options, k) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(p, p[1:]))]
        want = max((len(p), sum(overlap[i][j] for i, j in p)) for p in every)
        got = matching.monotone_alignment(overlap, 0.5)
        assert len(got) == want[0] and math.isclose(sum(o for *_, o in got), want[1])


def test_boxes_and_alignment_by_item(spark):
    box = [F.lit(float(v)) for v in (0, 0, 2, 2)], [F.lit(float(v)) for v in (1, 0, 3, 2)]
    assert math.isclose(spark.range(1).select(matching.box_overlap(*box).alias("o")).first().o, 1 / 3)
    left = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0), ("a", 1, 2.0, 0.0, 3.0, 1.0), ("b", 0, 0.0, 0.0, 1.0, 1.0)], "item string, pos long, x0 double, y0 double, x1 double, y1 double")
    right = spark.createDataFrame([("a", 0, 2.0, 0.0, 3.0, 1.0)], left.schema)
    assert [(r.item, r.l_pos, r.r_pos) for r in matching.aligned_tokens(left, right, "item", 0.5).collect()] == [("a", 1, 0)]


def test_rights_and_locators(spark):
    rows = spark.createDataFrame([(None, True, True), ("restricted", True, True), ("open_licensed", False, True), ("open_licensed", True, False), ("open_licensed", True, True)], "s string, d boolean, r boolean")
    got = [r.f for r in rows.select(quarantine.rights_finding(F.col("s"), F.col("d"), F.col("r"), "training").alias("f")).collect()]
    assert got == ["rights_status_not_permitted", "rights_status_not_permitted", "derivatives_not_permitted", "redistribution_not_permitted", None]
    pages = spark.createDataFrame([("1", "HTTPS://Example.org/ｘ"), ("2", "http://other"), ("3", None)], "id string, url string")
    patterns = spark.createDataFrame([("r1", "https://example.org/x"), ("r2", "https://example.org"), ("r3", "ftp:")], "rule_id string, pattern string")
    assert sorted((r.id, r.rule_id) for r in quarantine.locator_matches(pages, patterns, "url").collect()) == [("1", "r1"), ("1", "r2")]
    with pytest.raises(PermissionError):
        quarantine.require_permitted(spark.createDataFrame([("a", "code")], "artifact_id string, code string"))


def test_admission_guard(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "id string, marker string")
    assert quarantine.admitted(df, "marker").count() == 2
    with pytest.raises(Exception, match="not admitted"):
        quarantine.admitted(df.union(spark.createDataFrame([("c", "x")], df.schema)), "marker").collect()


def test_modern_dates_and_tokens(spark):
    cases = {"": False, "Modern cast": True, "1850 BCE": False, "20th century": True, "1850-1901": True, "1850 or 2500": False, "12345": False, "contemporary": True}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.m for r in df.select("d", metadata.clearly_modern(F.col("d")).alias("m")).collect()} == cases
    assert spark.createDataFrame([("Steatite;  Plaster of  Paris / clay,",)], "v string").select(metadata.token_set(F.col("v")).alias("t")).first().t == ["steatite", "plaster of paris", "clay"]


def test_reviews_fail_closed(spark):
    subjects = spark.createDataFrame([("a", True), ("b", False)], "s string, ready boolean")
    none = spark.createDataFrame([], "e string")
    assert reviews.ready_totals(subjects, none).first().ready == 1
    assert reviews.ready_totals(subjects, spark.createDataFrame([("bad",)], "e string")).first().ready == 0
    made = spark.createDataFrame([("k", "x"), ("k", "z")], "key string, value string")
    assert [r.value for r in reviews.no_invention(made, spark.createDataFrame([("k", "x"), ("j", "z")], made.schema), ["key"], "value").collect()] == ["z"]


def test_nested_folds_hold_out_and_deal_the_rest(spark):
    rng = random.Random(4)
    rows = [(f"f{i}", *(rng.choice([1, 2, 5]) for _ in range(2))) for i in range(30)]
    df = spark.createDataFrame(rows, "family string, x long, y long")
    outer = {r.family: r.fold for r in labelling.greedy_folds(df, "family", ["x", "y"], 3, "outer").collect()}
    got = {(r.outer, r.family): r.inner for r in labelling.nested_folds(df, "family", ["x", "y"], 3, 2).collect()}
    assert len(got) == 90
    for (o, family), inner in got.items():
        assert (inner is None) == (outer[family] == o) and inner in (None, 0, 1)


def test_counter_streams_are_fair_and_repeatable():
    from seqloom.functions.streams import CounterStream

    a, b = CounterStream(b"k", "label", 3), CounterStream(b"k", "label", 3)
    assert [a.below(7) for _ in range(50)] == [b.below(7) for _ in range(50)]
    assert CounterStream(b"k", "label", 4).below(10**9) != CounterStream(b"k", "label", 3).below(10**9)
    s = CounterStream(b"k", "x")
    counts = [0] * 5
    for _ in range(2000):
        counts[s.below(5)] += 1
    assert min(counts) > 320 and sorted(s.shuffled(range(20))) == list(range(20)) and len(set(s.sample("abcdef", 4))) == 4
    with pytest.raises(ValueError):
        s.below(0)


def test_synthetic_corpus_is_learnable(spark):
    from seqloom.sources.synthetic import CLASSES, known_script

    rows = known_script(spark, 60).withColumn("weight", F.lit(1.0))
    assert {r.family: r.n for r in rows.groupBy("family").agg(F.count("*").alias("n")).collect()}.values() and set(rows.groupBy("family").count().toPandas()["count"]) <= set(range(6, 12))
    split = rows.withColumn("test", F.col("family") >= "family-00000045")
    found = labelling.bayes_scores(split.filter("test"), split.filter("NOT test"), ["form"], ["family", "pos"], CLASSES).collect()
    assert sum(r.truth == r.predicted for r in found) > 0.95 * len(found)
