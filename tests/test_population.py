"""Commitments, populations and exact orderings."""

import itertools
import random
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from seqloom.functions import exact
from seqloom.operators import commitments, population


def test_digests_ignore_order_and_see_changes(spark):
    df = spark.createDataFrame([(f"r/{i}", i, f"{i:064d}") for i in range(300)], "file string, bytes long, content_sha256 string")
    one, two = (commitments.tree_commitment(d, "r").first() for d in (df, df.orderBy(F.desc("bytes")).repartition(5)))
    assert one == two and one.rows == 300 and one.bytes == sum(range(300))
    other = df.withColumn("content_sha256", F.when(F.col("bytes") == 7, "x").otherwise(F.col("content_sha256"))).filter("bytes <> 9")
    assert commitments.tree_commitment(other, "r").first().digest != one.digest
    assert sorted(map(tuple, commitments.differences(other, df).collect())) == [("r/7", "changed"), ("r/9", "missing")]
    assert commitments.state_commitment({"b": 1, "a": [2.5]}) == commitments.state_commitment({"a": [2.5], "b": 1})


def test_observations_commit_to_equality_only(spark):
    rows = [("d", 0, 1, "A", False), ("d", 0, 2, "B", False), ("d", 1, 1, "A", True), ("d", 1, 2, None, True)]
    df = spark.createDataFrame(rows, "doc string, line int, pos int, form string, damaged boolean")
    same = df.withColumn("form", F.translate("form", "AB", "XY")).repartition(3)
    other = df.withColumn("form", F.lit("A"))
    a, b, c = (commitments.observation_commitment(d, "doc", "line").first().digest for d in (df, same, other))
    assert a == b != c


def test_components_exclusions_and_contexts(spark):
    units = spark.createDataFrame([(u,) for u in "abcdef"], "unit string")
    relations = spark.createDataFrame([("a", "b", "union"), ("b", "c", "union"), ("c", "d", "exclude_both")], "left string, right string, kind string")
    got = {r.unit: (r.component, r.excluded) for r in population.closed_components(units, relations).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", True), "e": ("e", False), "f": ("f", False)}
    members = spark.createDataFrame([("x", False, True, True, "s1", True), ("x", True, False, False, "s2", False), ("y", False, False, True, None, True), ("z", False, False, False, "s3", True)], "component string, prior_exposure boolean, conflict boolean, dependence boolean, site string, ok boolean")
    assert {r.component: r.reason for r in population.exclusion_reasons(members).collect()} == {"x": "prior_exposure", "y": "dependence", "z": None}
    contexts = {r.component: (r.site, r.site_trigger) for r in population.component_contexts(members, ["site"], "ok").collect()}
    assert contexts == {"x": (["s1", "s2"], ["s1"]), "y": ([], []), "z": (["s3"], ["s3"])}


def test_invariants_ladders_and_pseudonyms(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("b", 3)], "id string, n int")
    assert {(r.value, r.code) for r in population.population_issues(df, "id", "n").collect()} == {("b", "duplicate_id"), (None, "source_order_not_consecutive")}
    state = population.first_failure([("no_id", F.col("id").isNotNull()), ("late", F.col("n") < 2)], "ready")
    assert [r.s for r in df.orderBy("n").select(state.alias("s")).collect()] == ["ready", "ready", "late"]
    named = population.pseudonyms(df, "id", b"key", "p").collect()
    assert len({r.opaque_id for r in named}) == 2 and sum(r.repeated for r in named) == 2 and all(r.opaque_id.startswith("p:") for r in named)


def test_surds_are_ordered_exactly():
    getcontext().prec = 120
    rng = random.Random(2)
    for _ in range(200):
        terms = [(rng.randint(-(10**12), 10**12), rng.randint(1, 10**24)) for _ in range(rng.randint(1, 4))]
        value = sum((Decimal(c) / Decimal(r).sqrt() for c, r in terms), Decimal(0))
        assert exact.surd_sum_sign(terms) == (value > 0) - (value < 0)
    assert exact.surd_sum_sign([(1, 2), (1, 8), (-3, 8)]) == 0  # 1/r2 + 1/(2 r2) - 3/(2 r2)
    assert exact.surd_sum_sign([(10**30, 2), (-(10**30) + 1, 2)]) == 1
    rhos = [(3, 16), (-1, 4), (1, 9), (2, 4)]
    for a, b in itertools.product(rhos, rhos):
        want = (a[0] / a[1] ** 0.5) - (b[0] / b[1] ** 0.5)
        assert exact.surd_sum_sign([a, (-b[0], b[1])]) == (want > 1e-12) - (want < -1e-12)
    assert exact.compare_deltas(exact.delta_terms((3, 16), [(1, 9), (-1, 4)]), exact.delta_terms((3, 16), [(-1, 9)])) == -1
