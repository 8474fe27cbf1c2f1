"""Linear-chain CRF: partial losses and gradients on executors, a deterministic L-BFGS on the driver.

The parameters are one weight for each (state, feature), a bias and a start for
each state, and a weight for each pair of states: their number is bounded by the
feature vocabulary, which fit() checks. Lines stay where they are; only one loss
and one gradient for each partition come back, in order of partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import Scratch, ship_package

RIDGE = 0.01
#: Parameters at most: a gradient of them is what a task returns.
MOST_PARAMETERS = 2_000_000


@dataclass
class Layout:
    states: list[str]
    features: dict[str, int]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.states), len(self.features)

    @property
    def size(self) -> int:
        s, f = self.shape
        return s * f + 2 * s + s * s

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emission, bias, start and transition weights as views of one vector."""
        s, f = self.shape
        e = s * f
        return w[:e].reshape(s, f), w[e : e + s], w[e + s : e + 2 * s], w[e + 2 * s :].reshape(s, s)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def line_loss(w: np.ndarray, layout: Layout, rows: list[list[int]], gold: list[int], weight: float, gradient: np.ndarray) -> float:
    """Weighted negative log-likelihood of a line; its gradient is added to gradient."""
    emit, bias, start, move = layout.split(w)
    g_emit, g_bias, g_start, g_move = layout.split(gradient)
    n = len(rows)
    e = np.stack([emit[:, r].sum(axis=1) + bias for r in rows])
    forward, backward = np.empty_like(e), np.zeros_like(e)
    forward[0] = e[0] + start
    for t in range(1, n):
        forward[t] = e[t] + log_sum(forward[t - 1][:, None] + move, 0)
    for t in range(n - 2, -1, -1):
        backward[t] = log_sum(move + e[t + 1] + backward[t + 1], 1)
    z = float(log_sum(forward[-1], 0))
    score = start[gold[0]] + sum(e[t, gold[t]] for t in range(n)) + sum(move[gold[t - 1], gold[t]] for t in range(1, n))
    mass = np.exp(forward + backward - z)
    mass[np.arange(n), gold] -= 1
    mass *= weight
    for t, r in enumerate(rows):
        np.add.at(g_emit, (slice(None), r), mass[t][:, None])
    g_bias += mass.sum(axis=0)
    g_start += mass[0]
    for t in range(1, n):
        pair = np.exp(forward[t - 1][:, None] + move + e[t] + backward[t] - z)
        pair[gold[t - 1], gold[t]] -= 1
        g_move += weight * pair
    return weight * (z - float(score))


def objective(lines: DataFrame, layout: Layout, alike: list[tuple[str, str]] | None = None) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient over lines (features array<array<int>>, states array<int>, weight), ridge included, and contrast_ridge for states to be kept alike."""
    spark = lines.sparkSession
    ship_package(spark)

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(w)  # at most MOST_PARAMETERS numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, loss, seen = np.zeros(layout.size), 0.0, False
            for batch in batches:
                for rows, gold, weight in zip(*(batch.column(c).to_pylist() for c in ("features", "states", "weight")), strict=True):
                    loss += line_loss(sent.value, layout, rows, gold, weight, gradient)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["loss", "gradient"])

        parts = lines.select("features", "states", "weight").mapInArrow(run, "loss double, gradient binary").withColumn("p", F.spark_partition_id()).collect()
        parts.sort(key=lambda r: r.p)  # sums in one order give the same model each time
        sent.unpersist()
        extra, slope = contrast_ridge(layout, w, alike or [])
        total = sum((np.frombuffer(r.gradient) for r in parts), RIDGE * w + slope)
        return sum(r.loss for r in parts) + 0.5 * RIDGE * float(w @ w) + extra, total

    return evaluate


def minimize(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, history: int = 10, close: float = 1e-5) -> tuple[np.ndarray, float, int]:
    """L-BFGS with Armijo steps; the same inputs give the same result."""
    w = start.astype(float).copy()
    value, gradient = evaluate(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for step in range(steps):
        if np.abs(gradient).max() <= close:
            return w, value, step
        q, alphas = gradient.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * float(s @ q)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - rho * float(y @ q))
        direction = -q
        slope = float(gradient @ direction)
        if slope >= 0:
            pairs, direction = [], -gradient
            slope = -float(gradient @ gradient)
        length = 1.0 if pairs else min(1.0, 1 / max(1e-12, float(np.abs(gradient).sum())))
        for _ in range(31):
            trial, new = evaluate(w + length * direction)
            if trial <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            return w, value, step
        s, y = length * direction, new - gradient
        if float(s @ y) > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs = [*pairs, (s, y, 1 / float(s @ y))][-history:]
        settled = abs(value - trial) <= 1e-9 * max(1.0, abs(value))
        w, value, gradient = w + s, trial, new
        if settled:
            return w, value, step + 1
    return w, value, steps


@dataclass
class Crf:
    layout: Layout
    weights: np.ndarray
    loss: float
    steps: int


def encode(tokens: DataFrame, line: list[str], features: list[str], layout: Layout) -> DataFrame:
    """Lines with feature numbers and states; values outside the vocabulary have no number."""
    spark = tokens.sparkSession
    known = spark.createDataFrame([(k, v) for k, v in layout.features.items()], "name string, number int")
    states = spark.createDataFrame([(s, k) for k, s in enumerate(layout.states)], "truth string, state int")
    long = tokens.select(*line, "pos", "truth", "weight", F.explode(F.array(*(F.concat(F.lit(f"{f}="), F.col(f)) for f in features))).alias("name"))
    numbered = long.join(known, "name", "left").groupBy(*line, "pos", "truth", "weight").agg(F.array_sort(F.array_compact(F.collect_list("number"))).alias("own"))
    placed = numbered.join(F.broadcast(states), "truth")
    rows = F.array_sort(F.collect_list(F.struct("pos", "own", "state")))
    return placed.groupBy(*line).agg(rows.alias("r"), F.sum("weight").alias("mass"), F.count("*").alias("n")).select(
        *line, F.transform("r", lambda t: t["own"]).alias("features"), F.transform("r", lambda t: t["state"]).alias("states"), (F.col("mass") / F.col("n")).alias("weight")
    )


def fit(tokens: DataFrame, line: list[str], features: list[str], states: list[str], least: int = 2, steps: int = 100, alike: list[tuple[str, str]] | None = None) -> Crf:
    """Fit on tokens with pos, truth, weight and text features; a value must occur `least` times to be a feature. alike: states whose emissions are kept close."""
    scratch = Scratch(tokens.sparkSession, "crf")
    names = tokens.select(F.explode(F.array(*(F.concat(F.lit(f"{f}="), F.col(f)) for f in features))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    most = MOST_PARAMETERS // max(1, len(states))
    vocabulary = sorted(r.name for r in names.limit(most + 1).collect())
    if len(vocabulary) > most:
        raise ValueError("more features than MOST_PARAMETERS allows; raise `least`")
    layout = Layout(states, {n: k for k, n in enumerate(vocabulary)})
    lines = scratch.keep(encode(tokens, line, features, layout), "lines")
    w, loss, done = minimize(objective(lines, layout, alike), np.zeros(layout.size), steps)
    return Crf(layout, w, loss, done)


def decode(model: Crf, lines: DataFrame, line: list[str], strength: float = 1.0, prior: np.ndarray | None = None) -> DataFrame:
    """(line, states array<string>) by Viterbi; prior is subtracted from each state's emission, strength scales transitions."""
    ship_package(lines.sparkSession)
    sent = lines.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {t}" for c, t in lines.select(*line).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        emit, bias, start, move = m.layout.split(m.weights)
        for batch in batches:
            out = []
            for rows in batch.column("features").to_pylist():
                e = np.stack([emit[:, r].sum(axis=1) + bias for r in rows]) - (0 if prior is None else prior)
                score, back = e[0] + start, []
                for t in range(1, len(rows)):
                    options = score[:, None] + strength * move
                    back.append(options.argmax(axis=0))
                    score = options.max(axis=0) + e[t]
                path = [int(score.argmax())]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                out.append([m.layout.states[k] for k in reversed(path)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in line), pa.array(out, pa.list_(pa.string()))], names=[*line, "path"])

    return lines.select(*line, "features").mapInArrow(run, f"{kinds}, path array<string>")


def prior_adjustment(counts: list[float], gamma: float = 0.5) -> np.ndarray:
    """gamma times the log of each class's share by Jeffreys' rule."""
    n = np.array(counts, float) + 0.5
    return gamma * np.log(n / n.sum())


def contrast_ridge(layout: Layout, w: np.ndarray, pairs: list[tuple[str, str]], factor: float = 2.0) -> tuple[float, np.ndarray]:
    """Extra penalty, and its gradient, on the difference of two states' emissions for each pair of states to be kept alike."""
    gradient = np.zeros_like(w)
    emit, *_ = layout.split(w)
    g_emit, *_ = layout.split(gradient)
    value = 0.0
    for a, b in pairs:
        i, j = layout.states.index(a), layout.states.index(b)
        d = emit[i] - emit[j]
        value += 0.25 * RIDGE * (factor - 1) * float(d @ d)
        g_emit[i] += 0.5 * RIDGE * (factor - 1) * d
        g_emit[j] -= 0.5 * RIDGE * (factor - 1) * d
    return value, gradient
