"""CRF gradients and fits, and bitmap operators, against brute force and closed forms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import crf, imaging


def test_gradient_equals_differences():
    layout = crf.Layout(["a", "b", "c"], {f"f{k}": k for k in range(4)})
    rng = np.random.default_rng(1)
    w, rows, gold = rng.normal(size=layout.size), [[0, 2], [1], [], [3, 0]], [0, 2, 1, 1]
    gradient = np.zeros(layout.size)
    value = crf.line_loss(w, layout, rows, gold, 0.7, gradient)
    emit, bias, start, move = layout.split(w)
    score = lambda p: start[p[0]] + sum(emit[p[t], r].sum() + bias[p[t]] for t, r in enumerate(rows)) + sum(move[p[t - 1], p[t]] for t in range(1, 4))
    z = np.log(sum(np.exp(score(p)) for p in itertools.product(range(3), repeat=4)))
    assert abs(value - 0.7 * (z - score(gold))) < 1e-9
    for k in rng.choice(layout.size, 10, replace=False):
        step = np.zeros(layout.size)
        step[k] = 1e-6
        up, down = (crf.line_loss(w + s, layout, rows, gold, 0.7, np.zeros(layout.size)) for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-5


def test_minimize_finds_the_bottom():
    a = np.diag([1.0, 10.0, 100.0])
    w, value, _ = crf.minimize(lambda x: (0.5 * float((x - 1) @ a @ (x - 1)), a @ (x - 1)), np.zeros(3))
    assert np.allclose(w, 1, atol=1e-4) and value < 1e-6


def test_fit_and_decode(spark):
    rows = [(f"l{n}", p + 1, "x" if (n + p) % 2 else "y", f"v{(n + p) % 2}", 1.0) for n in range(30) for p in range(4)]
    tokens = spark.createDataFrame(rows, "line string, pos int, truth string, form string, weight double").repartition(3)
    model = crf.fit(tokens, ["line"], ["form"], ["x", "y"], steps=30)
    found = crf.decode(model, crf.encode(tokens, ["line"], ["form"], model.layout), ["line"])
    want = {f"l{n}": ["x" if (n + p) % 2 else "y" for p in range(4)] for n in range(30)}
    assert {r.line: r.path for r in found.collect()} == want
    again = crf.fit(tokens.repartition(3), ["line"], ["form"], ["x", "y"], steps=30)
    assert np.allclose(again.weights, model.weights, atol=1e-6)
    emissions = lambda m: m.layout.split(m.weights)[0]
    close = crf.fit(tokens, ["line"], ["form"], ["x", "y"], steps=30, alike=[("x", "y")])
    assert np.abs(np.subtract(*emissions(close))).sum() < np.abs(np.subtract(*emissions(model))).sum()


def test_contrast_penalty_gradient():
    layout = crf.Layout(["a", "b"], {"f": 0, "g": 1})
    w = np.arange(layout.size, dtype=float)
    value, gradient = crf.contrast_ridge(layout, w, [("a", "b")])
    assert value > 0
    step = np.eye(layout.size)[0] * 1e-6
    assert abs((crf.contrast_ridge(layout, w + step, [("a", "b")])[0] - value) / 1e-6 - gradient[0]) < 1e-4


BANDS = [(100, 300), (2400, 2600)]


def pages(spark, *pages_):
    rows = [(f"p{k}", p.shape[1], p.shape[0], bytes(np.packbits(p, axis=1).tobytes())) for k, p in enumerate(pages_)]
    return spark.createDataFrame(rows, "file string, width int, height int, content binary")


def test_lattices_are_found_or_abstained_from(spark):
    good = imaging.synthetic_page(6700, 4720, [(130, 600, 165), (2430, 610, 165)], 34)
    apart = imaging.synthetic_page(6700, 4720, [(130, 600, 160), (2430, 610, 170)], 34)
    blank = np.zeros((6700, 4720), np.uint8)
    df = pages(spark, good, apart, blank)
    for detect in (imaging.detect_labels, imaging.detect_two_tier):
        found = {r.file: r for r in detect(df, BANDS).collect()}
        # The ink lattice takes the smallest pitch whose windows hold all ink; pairs of tiers give the pitch itself.
        assert found["p0"].status == "proposed" and all(0 <= 165 - p <= (2 if detect is imaging.detect_labels else 0) for p in found["p0"].pitches), found["p0"]
        assert "lane_pitch_disagreement" in found["p1"].codes
        assert found["p2"].status == "abstained"


def test_runs():
    assert imaging.longest_run([], 5) == 0 and imaging.longest_run([1, 6, 11, 20, 25], 5) == 3
    assert imaging.runs_of(np.array([1, 1, 0, 1, 0, 0, 1])) == [(0, 2), (3, 4), (6, 7)]


def glyph(kind):
    g = np.zeros((20, 14), np.uint8)
    if kind == "bar":
        g[:, 5:9] = 1
    elif kind == "ring":
        g[2:18, 1:13] = 1
        g[6:14, 5:9] = 0
    else:
        g[9:12, :] = 1
        g[2:18, 0:2] = 1
    return g


def test_glyphs_match_their_own_template(spark):
    kinds = ["bar", "ring", "cross"]
    templates = [imaging.Template.of(k, kind, glyph(kind)) for k, kind in enumerate(kinds)]
    for k, kind in enumerate(kinds):
        cost, rank, _, margin = imaging.rank_templates(glyph(kind), templates)[0]
        assert (cost, rank) == (0, k) and margin > 0 and imaging.stable_under_shifts(glyph(kind), templates)
    row = np.zeros((24, 70), np.uint8)
    for x, kind in ((3, "ring"), (25, "bar"), (45, "cross")):
        row[2:22, x : x + 14] = glyph(kind)
    loss, pieces = imaging.segment_row(row, templates)[0]
    assert [r for *_, r in pieces] == [1, 0, 2]
    rows = pages(spark, row, np.zeros((24, 70), np.uint8))
    catalogue = spark.createDataFrame([(k, kind, 14, 20, bytes(np.packbits(glyph(kind), axis=1).tobytes())) for k, kind in enumerate(kinds)], "rank int, variant string, width int, height int, content binary")
    found = {r.file: r for r in imaging.match_glyphs(rows, catalogue).collect()}
    assert [p["rank"] for p in found["p0"].pieces] == [1, 0, 2] and found["p0"].status == "proposed" and found["p1"].status == "no_match"


def test_normalisation_and_costs():
    n = imaging.normalize(glyph("bar"))
    assert n.shape == (64, 64) and imaging.tight(n).shape[0] == 56
    with pytest.raises(ValueError):
        imaging.normalize(np.zeros((3, 3), np.uint8))
    assert imaging.overlap_cost(n, n) == 0 and imaging.overlap_cost(n, np.zeros_like(n)) == imaging.SCALE and imaging.aspect_cost((2, 4), (1, 2)) == 0
    one = np.zeros((3, 3), np.uint8)
    one[1, 1] = 1
    assert imaging.dilate(one).sum() == 9


def test_grid_and_crops(spark):
    scores = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False)], "cost double, right boolean")
    assert imaging.calibrate(scores, [0.5, 2.5, 3.5]).first().threshold == 2.5
    box = spark.createDataFrame([(0, 5, 10, 20)], "x0 int, y0 int, x1 int, y1 int")
    r = imaging.crop_rows(box, 5, 500, 10, 10, 100, 25).select(F.array("row_x0", "row_y0", "row_x1", "row_y1").alias("b")).first().b
    assert r == [15, 0, 100, 25]
