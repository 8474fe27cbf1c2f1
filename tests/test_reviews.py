"""Review ledgers: adjudications that stand or don't, totals that fail closed, comparisons, staging."""

from seqloom.operators import reviews

SCHEMA = "review_id string, subject_id string, assignment_id string, actor_id string, at int, complete boolean, stage string, supersedes string, inputs array<string>"
BASE = [
    ("r1", "s", "a1", "p1", 1, True, "independent", None, None), ("r2", "s", "a2", "p2", 2, True, "independent", None, None), ("r3", "s", "a1", "p1", 3, True, "independent", "r1", None),
    ("d1", "s", "a9", "p9", 5, True, "adjudication", None, ["r2", "r3"]),
]
PROTECTED = ["subject_id", "assignment_id", "actor_id"]


def problems(spark, *extra, base=BASE):
    rows = spark.createDataFrame([*base, *extra], SCHEMA)
    found = reviews.adjudication_problems(rows, reviews.supersession_edges(rows, PROTECTED))
    return rows, {(r.decision_id, r.problem) for r in found.collect()}


def test_a_sound_decision_stands(spark):
    rows, found = problems(spark)
    assert found == set()
    total = reviews.ledger_totals(rows, PROTECTED).first()
    assert tuple(total) == (4, 1, 1, 0)


def test_each_fault_is_named(spark):
    bad = [
        ("d2", "s", "a9", "p9", 5, True, "adjudication", None, ["r1", "r2"]), ("d3", "s", "a2", "p2", 6, True, "adjudication", None, ["r2", "r3"]), ("d4", "s", "a8", "p8", 2, True, "adjudication", None, ["r2", "r3", "zz"]),
        ("x1", "t", "b1", "p3", 1, False, "independent", None, None), ("d5", "t", "b9", "p9", 9, True, "adjudication", None, ["x1", "r2", "d1"]),
    ]
    rows, found = problems(spark, *bad)
    by = {d: {p for e, p in found if e == d} for d in ("d1", "d2", "d3", "d4", "d5")}
    assert by["d1"] == set() and by["d2"] == {"input_superseded"} and by["d3"] == {"adjudicator_is_author", "assignment_reused"}
    assert by["d4"] == {"inputs_do_not_cover", "input_later", "missing_input"}
    assert by["d5"] == {"inputs_do_not_cover", "input_incomplete", "input_of_other_subject", "input_not_independent", "too_few_actors", "too_few_assignments"}
    total = reviews.ledger_totals(rows, PROTECTED).first()
    assert (total.ready_subjects, total.sound_decisions) == (0, 0) and total.errors > 0


def test_edges_name_their_fault(spark):
    rows = spark.createDataFrame([*BASE, ("r4", "s", "a7", "p1", 4, True, "independent", "r2", None), ("r5", "s", "a1", "p1", 3, True, "independent", "nope", None)], SCHEMA)
    assert {r.review_id: r.problem for r in reviews.supersession_edges(rows, PROTECTED).collect()} == {"r3": None, "r4": "protected_field_changed", "r5": "unknown_review"}


def test_comparison_and_staging(spark):
    schema = "cell int, sign string, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, "A", 0.0, 0.0, 2.0, 2.0), (2, "B", 0.0, 0.0, 1.0, 1.0)], schema)
    right = spark.createDataFrame([(1, "A", 1.0, 0.0, 3.0, 2.0), (3, "C", 0.0, 0.0, 1.0, 1.0)], schema)
    row = reviews.comparison(left, right, ["cell"]).first()
    assert (row.cells, row.shared, row.sign_agreement) == (3, 1, 1.0) and abs(row.mean_overlap - 1 / 3) < 1e-9
    tokens = spark.createDataFrame([("a", "d1", "A", "l1", 1, "Y"), ("a", "d1", "A", "l1", 0, "X"), ("b", "d2", "A", "l1", 0, "Z")], "artifact_id string, decision_id string, side_id string, line_id string, visual_index int, sign_id string")
    (staged,) = reviews.staged_artifacts(tokens, spark.createDataFrame([("d2", "p")], "decision_id string, problem string")).collect()
    assert staged.artifact_id == "a" and [t.sign_id for t in staged.sides[0].lines[0].tokens] == ["X", "Y"]
