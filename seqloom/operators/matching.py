"""Matching of intervals and boxes: candidates by joins, ordered optima by dynamic programming within a lane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import ship_package

#: Pairs of a lane whose chain lengths are held at once.
HELD = 1 << 20


def interval_candidates(points: DataFrame, intervals: DataFrame, lane: list[str], width: int) -> DataFrame:
    """Pairs of points (anchor) and half-open intervals [y0, y1) of the same lane.

    Both sides are cut into bands of `width`, so the join is an equality on lane and
    band; an interval spans as many bands as it is long.
    """
    p = points.withColumn("__band", F.floor(F.col("anchor") / width))
    spans = F.sequence(F.floor(F.col("y0") / width), F.floor((F.col("y1") - 1) / width))
    i = intervals.filter("y1 > y0").withColumn("__band", F.explode(spans))
    return p.join(i, [*lane, "__band"]).filter("anchor >= y0 AND anchor < y1").drop("__band")


def _alive(anchors: np.ndarray, y0: np.ndarray, y1: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
    """For each of the anchors first to last - 1 the places of the spans that hold it, ascending."""
    upto = np.searchsorted(y0, anchors[first:last], "right")
    open_, seen = np.zeros(0, np.int64), 0
    for at, p in zip(anchors[first:last], upto):
        open_ = np.concatenate([open_, np.arange(seen, p)]) if p > seen else open_
        open_, seen = open_[y1[open_] > at], int(p)
        yield open_


def _lengths(ends: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How long a chain can end at each of the ascending places held; ends[k], which follows, is the least place at which one of k ends."""
    length = np.searchsorted(ends, held, "left")
    new = np.r_[True, length[1:] > length[:-1]]  # the first of each length is the least
    ends[length[new]] = np.minimum(ends[length[new]], held[new])
    return length


def ordered_matchings(anchors: list[int], spans: list[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
    """Size of the largest one-to-one, order-keeping matching, how many there are (2: more than one), and one of them.

    anchors and spans are sorted. A matching is a chain of pairs (anchor, span that
    holds it) that ascends in both; each anchor's pairs look up how long a chain may
    end at them (and, from behind, start) among the least ends of chains of each
    length. There is one largest matching if as many pairs lie on largest ones as
    it has. Time goes with the pairs, not with anchors times spans; memory holds
    the lengths of HELD pairs, as those of a block of anchors are found once more
    on the way back.
    """
    n, m = len(anchors), len(spans)
    at, (y0, y1) = np.array(anchors, np.int64), np.array(spans, np.int64).reshape(-1, 2).T
    least = min(n, m) + 2
    ends = np.full(least, m, np.int64)
    ends[0] = -1
    blocks, pairs = [(0, ends.copy())], 0
    for i, held in enumerate(_alive(at, y0, y1, 0, n)):
        if pairs and pairs + len(held) > HELD:
            blocks.append((i, ends.copy()))
            pairs = 0
        pairs += len(held)
        if len(held):
            _lengths(ends, held)
    size = int(np.count_nonzero(ends < m)) - 1
    back = np.full(least, m, np.int64)  # places counted from behind
    back[0] = -1
    on, chain, after, want = 0, [], m, size
    stop = n
    for first, before in reversed(blocks):
        rows = [(held, _lengths(before, held) if len(held) else held) for held in _alive(at, y0, y1, first, stop)]
        for i in range(stop - 1, first - 1, -1):
            held, length = rows[i - first]
            if not len(held):
                continue
            rest = _lengths(back, m - 1 - held[::-1])[::-1]
            on += int(np.count_nonzero(length + rest == size + 1))
            if want and len(fits := held[(length == want) & (held < after)]):
                after, want = int(fits[-1]), want - 1
                chain.append((i, after))
        stop = first
    return size, 1 + (on > size), chain[::-1]


def lane_scores(points: DataFrame, intervals: DataFrame, lane: list[str]) -> DataFrame:
    """For each lane: predictions, references, matched, ambiguous. A lane is one task's work."""
    ship_package(points.sparkSession)
    kinds = dict(points.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in lane) + ", predictions bigint, references bigint, matched bigint, ambiguous boolean"

    def one(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors = sorted(left.column("anchor").to_pylist())
        spans = sorted(zip(right.column("y0").to_pylist(), right.column("y1").to_pylist(), strict=True))
        size, ways, _ = ordered_matchings(anchors, spans)
        own = {c: pa.array([k.as_py()], left.schema.field(c).type if c in left.schema.names and left.num_rows else right.schema.field(c).type) for c, k in zip(lane, key, strict=True)}
        return pa.table({**own, "predictions": [len(anchors)], "references": [len(spans)], "matched": [size], "ambiguous": [ways > 1]})

    return points.groupBy(*lane).cogroup(intervals.groupBy(*lane)).applyInArrow(one, schema)


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 where both are empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def monotone_alignment(overlap: list[list[float]], least: float) -> list[tuple[int, int, float]]:
    """Order-keeping pairs of overlap at least `least`: as many as can be, then of the largest total overlap."""
    n, m = len(overlap), len(overlap[0]) if overlap else 0
    best: list[list[tuple[int, float]]] = [[(0, 0.0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            top = max(best[i + 1][j], best[i][j + 1])
            if overlap[i][j] >= least:
                count, total = best[i + 1][j + 1]
                top = max(top, (count + 1, total + overlap[i][j]))
            best[i][j] = top
    out, i, j = [], 0, 0
    while i < n and j < m:
        count, total = best[i + 1][j + 1]
        if overlap[i][j] >= least and (count + 1, total + overlap[i][j]) == best[i][j]:
            out.append((i, j, overlap[i][j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] == best[i][j]:
            i += 1
        else:
            j += 1
    return out


def aligned_tokens(left: DataFrame, right: DataFrame, item: str, least: float) -> DataFrame:
    """(item, l_pos, r_pos, overlap) of two reviewers' tokens with pos and box (x0, y0, x1, y1), aligned within each item."""
    ship_package(left.sparkSession)

    def overlap(a: tuple, b: tuple) -> float:
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / union if union > 0 else 0.0

    def one(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        rows = [sorted(zip(*(t.column(c).to_pylist() for c in ("pos", "x0", "y0", "x1", "y1")), strict=True)) for t in (a, b)]
        found = monotone_alignment([[overlap(x[1:], y[1:]) for y in rows[1]] for x in rows[0]], least) if all(rows) else []
        name = key[0].as_py()
        return pa.table({item: pa.array([name] * len(found), pa.string()), "l_pos": pa.array([rows[0][i][0] for i, _, _ in found], pa.int64()), "r_pos": pa.array([rows[1][j][0] for _, j, _ in found], pa.int64()), "overlap": pa.array([o for _, _, o in found], pa.float64())})

    return left.groupBy(item).cogroup(right.groupBy(item)).applyInArrow(one, f"{item} string, l_pos bigint, r_pos bigint, overlap double")
