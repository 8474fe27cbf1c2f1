"""Quality classifier by co-training.

Two views of a document are classified apart: its content (words that tell the
classes apart, how they repeat, and how it is written) and its page metadata
(source, language, length class, and the layout of its lines and marks). Over a few rounds each
classifier labels the unlabelled documents it is most sure about, all of them
being candidates, and those become training rows of the other one. Both views are
then calibrated on labelled rows that neither was trained on, combined, and every
whole document is scored in one pass.

Labelled rows for fitting are a bounded sample: LABELLED documents at most, those
whose ids hash lowest. Pseudo-labels are chosen among all unlabelled documents by
rank, PSEUDO a round and view. Everything else covers all documents.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import distinct_name, map_batches
from seqloom.runtime import Scratch, ship_package

#: Labelled documents at most that the classifiers are fitted on.
LABELLED = 12_000
#: Words of the content view at most, how many labelled documents a word must occur in, and by how many standard errors its share must differ.
WORDS, WORD_LEAST, WORD_SURE = 512, 5, 4.0
#: Rounds; pseudo-labels that a view gives in the first one (twice as many in the second, and so on), dealt to the classes by their
#: share; how far at least from the share towards certainty a label must be; and the weight of a certain one.
ROUNDS, PSEUDO, LIFT, WEIGHT = 3, 200, 0.5, 0.25
META = 128
#: Share of labelled rows kept apart for calibration, in 1/10.
HELD = 3
#: Steps of log-odds in which the unlabelled documents are ranked.
STEPS = 16

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SIGNS = b"!#$%&*@^~|<>{}[]=+_\\/"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
CONTENT = ("repeats", "distinct", "words", "word_length")
LAYOUT = ("upper", "digits", "signs", "bars", "short_lines", "line_length")
SLOTS = 5


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def content(own: list[bytes]) -> list[float]:
    """How the words repeat, how many and how long they are; CONTENT names the numbers."""
    w = len(own)
    return [
        sum(map(operator.eq, own, own[1:])) / max(1, w - 1), len(set(own)) / max(1, w) if w < 200 else min(1.0, len(set(own)) / w * math.log(w) / math.log(200)),
        math.log1p(w), sum(map(len, own)) / max(1, w),
    ]


def layout(text: str | None) -> list[float]:
    """Shares of capitals, digits, marks, bars and short lines, and the mean length of lines; LAYOUT names the numbers."""
    raw = (text or "").encode()
    n, lines = len(raw) or 1, raw.split(b"\n")
    share = lambda chars: (n - len(raw.translate(None, chars))) / n if raw else 0.0
    return [share(_UPPER), share(_DIGITS), share(_SIGNS), raw.count(b"|") / n, sum(len(x) < 30 for x in lines) / len(lines), math.log1p(n / len(lines))]


def meta_slots(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Where a document's metadata falls in the hashed metadata view."""
    length = "none" if n_chars is None else str(int(max(0, n_chars)).bit_length())
    return [zlib.crc32(x.encode()) % META for x in (f"source={source}", f"lang={lang}", f"length={length}", f"source={source}&lang={lang}", f"lang={lang}&length={length}")]


def packed(text: str | None, source: str | None, lang: str | None, n_chars: int | None, at: dict[bytes, int]) -> bytes:
    """Both views of a document: five slots, the shape numbers, and which known words occur, ascending."""
    own = words(text)
    shape = np.array([*content(own), *layout(text)], "<f4").tobytes()
    return bytes(meta_slots(source, lang, n_chars)) + shape + np.array(sorted(at[w] for w in at.keys() & set(own)), "<u2").tobytes()


def unpacked(rows: list[bytes], known: int) -> tuple[np.ndarray, np.ndarray]:
    """The content view (words, then CONTENT and LAYOUT) and the metadata view (slots, then LAYOUT) of packed documents."""
    n, c = len(rows), len(CONTENT)
    shape = np.frombuffer(b"".join(r[SLOTS : SLOTS + 4 * (c + len(LAYOUT))] for r in rows), "<f4").reshape(n, c + len(LAYOUT))
    slots = np.frombuffer(b"".join(r[:SLOTS] for r in rows), np.uint8).reshape(n, SLOTS)
    hits = [np.frombuffer(r, "<u2", offset=SLOTS + 4 * (c + len(LAYOUT))) for r in rows]
    x, m = np.zeros((n, known + c + len(LAYOUT)), np.float32), np.zeros((n, META + len(LAYOUT)), np.float32)
    if n:
        x[np.repeat(np.arange(n), [len(h) for h in hits]), np.concatenate(hits)] = 1.0
    x[:, known:] = shape
    m[np.arange(n)[:, None], slots] = 1
    m[:, META:] = shape[:, c:]
    return x, m


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights and a last intercept for the given rows of x by Newton steps; the intercept isn't shrunk.

    Rows are taken in blocks, so that x is never copied as a whole.
    """
    width = x.shape[1] + 1
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(width)
    for _ in range(steps):
        gradient, curve = penalty * w, np.diag(penalty)
        for k in range(0, len(rows), 2048):
            part = np.ones((len(rows[k : k + 2048]), width))
            part[:, :-1] = x[rows[k : k + 2048]]
            p = sigmoid(part @ w)
            gradient = gradient + part.T @ (weight[k : k + 2048] * (p - y[k : k + 2048]))
            curve = curve + (part * (weight[k : k + 2048] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ part
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


@dataclass
class View:
    """A linear view of raw features (weights and an intercept) and its calibration (slope, intercept)."""

    weights: np.ndarray
    calibrated: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated[0] * (x @ self.weights[:-1] + self.weights[-1]) + self.calibrated[1]


@dataclass
class Model:
    """Both views and their combination: all that is sent to score a document."""

    vocabulary: list[bytes] = field(default_factory=list)
    #: The content view and the metadata view; none where they could not be fitted.
    views: tuple[View, View] | None = None
    #: Weights of the views' calibrated log-odds, and an intercept.
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    #: Probability of a good document where no view could be fitted.
    constant: float = 1.0
    #: For each round: pseudo-labels that the content view and the metadata view gave.
    given: list[tuple[int, int]] = field(default_factory=list)

    def scorer(self) -> Callable[[str | None, str | None, str | None, int | None], tuple[float, float, float]]:
        """A function giving P(good) by content, by metadata and by both."""
        if self.views is None:
            return lambda *_: (self.constant,) * 3
        (text, meta), k = self.views, len(self.vocabulary)
        at = {w: float(v) for w, v in zip(self.vocabulary, text.weights)}
        known = at.keys()
        of_shape, of_layout = text.weights[k:-1].tolist(), meta.weights[META:-1].tolist()
        of_slot, offsets = meta.weights[:META].tolist(), (float(text.weights[-1]), float(meta.weights[-1]))
        (a, b), (c, d) = text.calibrated.tolist(), meta.calibrated.tolist()
        u, v, z = self.both.tolist()
        p = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))

        def score(text, source, lang, n_chars):
            own, lines = words(text), layout(text)
            t = a * (offsets[0] + sum(at[w] for w in sorted(known & set(own))) + sum(map(operator.mul, of_shape, [*content(own), *lines]))) + b
            m = c * (offsets[1] + sum(of_slot[k] for k in set(meta_slots(source, lang, n_chars))) + sum(map(operator.mul, of_layout, lines))) + d
            return p(t), p(m), p(u * t + v * m + z)

        return score


def _columns(docs: DataFrame) -> DataFrame:
    """The columns the views read; those that docs lacks are null."""
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(*(F.col(c).cast(k).alias(c) if c in docs.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def judgements(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, good): one row for each labelled document; of several labels the worst counts."""
    judged = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.when((F.coalesce(F.min("quality"), F.lit(1)) > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0), 1).otherwise(0).alias("good")
    )
    return scratch.keep(judged, "judged")


def lowest(hashed: Column, most: int, rows: int) -> Column:
    """Whether a hash is among the lowest: a few more than `most` of so many rows are expected, so only those are ever sorted."""
    share = min(1.0, (most + 6 * math.sqrt(most)) / max(1, rows))
    return hashed <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1)


def sample(docs: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """Up to LABELLED labelled documents with good: those whose ids hash lowest, one row for each id (the smallest)."""
    some = lowest(F.xxhash64("doc_id"), LABELLED, judged.count())
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter(some).distinct()
    # An id must be both labelled and there; where few labelled documents are there, fewer are taken.
    known = scratch.keep(judged.filter(some).join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labelled")
    rows = _columns(docs).join(F.broadcast(known), "doc_id")  # at most LABELLED ids are sent
    one = rows.groupBy("doc_id", "good").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row"))
    return scratch.keep(one.select("doc_id", "good", "row.*"), "sample")


def vocabulary(rows: DataFrame) -> list[bytes]:
    """The words, WORDS at most, whose share of documents differs most surely between good and bad labelled rows."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [(w, g) for t, g in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True) for w in set(words(t))]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([g for _, g in pairs], pa.int64())], names=["word", "good"])

        return each

    own = rows.select("text", F.col("good").cast("bigint").alias("good"))
    n, good = own.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    bad = n - good
    if not good or not bad:
        return []
    counts = map_batches(own, "word binary, good bigint", make).groupBy("word").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    share = F.col("n") / n
    z = F.abs(F.col("g") / good - (F.col("n") - F.col("g")) / bad) / F.sqrt(share * (1 - share) * (1 / good + 1 / bad) + 1e-12)
    return [bytes(r.word) for r in counts.filter((F.col("n") >= WORD_LEAST) & (z >= WORD_SURE)).orderBy(z.desc(), "word").limit(WORDS).select("word").collect()]


def features(rows: DataFrame, known: list[bytes], *kept: str) -> DataFrame:
    """The kept columns and x, both views of each row packed."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        at = {w: k for k, w in enumerate(known)}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([packed(*r, at) for r in zip(*columns, strict=True)], pa.binary())], names=[*kept, "x"])

        return each

    out = T.StructType([*(rows.schema[c] for c in kept), T.StructField("x", T.BinaryType())])
    return map_batches(rows, out, make)


class Pool:
    """All unlabelled documents as distinct packed features, from which the surest are chosen."""

    def __init__(self, rows: DataFrame, known: int):
        self.rows, self.known = rows, known

    def surest(self, views: tuple[View, View], wanted: tuple[int, int], share: float) -> list[tuple[list[bytes], np.ndarray, np.ndarray]]:
        """For each view: the documents it is surest about, their labels, and how sure from 0 (the share) to 1.

        wanted: how many bad and how many good ones, by rank; ties are settled by
        hash, then by the features themselves. Ranking is by a histogram of
        log-odds, so only about as many rows as are wanted are ever sorted.
        """
        spark = self.rows.sparkSession
        sent, known = spark.sparkContext.broadcast(views), self.known  # WORDS + META numbers

        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                both = unpacked(batch.column("x").to_pylist(), known)
                logits = [v.logit(m.astype(np.float64)) for v, m in zip(sent.value, both, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column("x"), batch.column("tie"), *map(pa.array, logits)], names=["x", "tie", "z0", "z1"])

            return each

        scored = map_batches(self.rows.select("x", F.xxhash64("x").alias("tie")), "x binary, tie bigint, z0 double, z1 double", make)
        step = lambda z: F.least(F.greatest(F.floor(z * STEPS), F.lit(-40 * STEPS)), F.lit(40 * STEPS))
        one = scored.select(F.explode(F.array(*(F.struct(F.lit(v).alias("view"), step(F.col(f"z{v}")).alias("step")) for v in (0, 1)))).alias("s"))
        steps = {(r.view, r.step): r.n for r in one.groupBy("s.view", "s.step").agg(F.count("*").alias("n")).collect()}
        picks = []
        for v in (0, 1):
            for label, sign in ((0, -1), (1, 1)):
                z, own, above = F.col(f"z{v}") * sign, sorted(((s, n) for (w, s), n in steps.items() if w == v), key=lambda t: -sign * t[0]), 0
                for s, n in own:
                    if above + n >= wanted[label] or (s, n) == own[-1]:
                        inside = (step(F.col(f"z{v}")) == s) & lowest(F.col("tie"), max(1, wanted[label] - above), n)
                        picks.append((v, label, z, (step(F.col(f"z{v}")) * sign > s * sign) | inside))
                        break
                    above += n
        chosen = [
            scored.filter(there).select(F.lit(v).alias("view"), F.lit(label).alias("label"), z.alias("z"), "tie", "x").orderBy(F.col("z").desc(), "tie", "x").limit(wanted[label])
            for v, label, z, there in picks
        ]
        found = [r for part in chosen for r in part.collect()]  # at most wanted rows each
        out = []
        for v in (0, 1):
            rows = [r for r in found if r.view == v]
            label = np.array([float(r.label) for r in rows])
            base = np.where(label > 0, share, 1 - share)
            lift = (sigmoid(np.array([r.z for r in rows])) - base) / (1 - base)
            sure = lift >= LIFT
            out.append(([bytes(r.x) for r, s in zip(rows, sure, strict=True) if s], label[sure], lift[sure]))
        return out


def co_train(x: np.ndarray, m: np.ndarray, good: np.ndarray, pool, known: list[bytes]) -> Model:
    """Fit both views on labelled rows and on each other's sure pseudo-labels; calibrate and combine on held-out rows.

    pool.surest() gives what a round exchanges. Columns are scaled for fitting;
    the weights returned are those of the raw ones.
    """
    share = float(np.mean(good)) if len(good) else 1.0
    if len(good) < 20 or not 0 < share < 1:
        return Model(constant=share)
    held, train = (np.flatnonzero(part) for part in (np.arange(len(good)) % 10 < HELD, np.arange(len(good)) % 10 >= HELD))
    raw, ridge, dense = (x, m), (0.3, 1.0), (len(known), META)
    scales = []
    for v in (0, 1):
        own = raw[v][train][:, dense[v] :].astype(np.float64)
        width = raw[v].shape[1] - own.shape[1]
        scales.append((np.r_[np.zeros(width), own.mean(axis=0)], np.r_[np.ones(width), own.std(axis=0) + 1e-6]))
    taught: list[tuple] = [(np.zeros((0, r.shape[1]), np.float32), np.zeros(0), np.zeros(0)) for r in raw]  # what the other view taught each
    given = []
    for turn in range(ROUNDS + 1):
        views = []
        for v in (0, 1):
            extra, label, sure = taught[v]
            centre, scale = scales[v]
            rows = ((np.vstack([raw[v][train], extra]) - centre) / scale).astype(np.float32)
            w = fit_logistic(rows, np.arange(len(rows)), np.r_[good[train], label], np.r_[np.ones(len(train)), WEIGHT * sure], ridge[v])
            w = np.r_[w[:-1] / scale, w[-1] - (w[:-1] / scale) @ centre]
            logit = raw[v] @ w[:-1] + w[-1]
            views.append(View(w, fit_logistic(logit[:, None], held, good[held], np.ones(len(held)), 0.01)))
        if turn == ROUNDS:
            break
        wanted = PSEUDO * (turn + 1)
        many = max(1, round(wanted * share)) if wanted else 0
        found = pool.surest((views[0], views[1]), (max(1, wanted - many) if wanted else 0, many), share)
        given.append((len(found[0][0]), len(found[1][0])))
        for v in (0, 1):
            rows, label, sure = found[1 - v]
            taught[v] = (unpacked(rows, len(known))[v], label, sure)
    logits = np.stack([view.logit(r) for view, r in zip(views, raw, strict=True)], axis=1)
    both = fit_logistic(logits, held, good[held], np.ones(len(held)), 0.01)
    return Model(known, (views[0], views[1]), both, share, given)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    judged = judgements(labels, scratch)
    rows = sample(docs, judged, scratch)
    known = vocabulary(rows)
    got = features(rows, known, "doc_id", "good").toPandas().sort_values("doc_id", kind="stable")  # at most LABELLED rows
    everything = features(_columns(docs), known, "doc_id")
    unlabelled = everything.join(judged.select("doc_id"), "doc_id", "left_anti").select("x").distinct()
    pool = Pool(scratch.keep(unlabelled, "pool"), len(known))
    model = co_train(*unpacked(got.x.tolist(), len(known)), got.good.to_numpy(dtype=np.float64), pool, known)
    scratch.drop(judged, rows, pool.rows)
    return model


def score(docs: DataFrame, model: Model, names: tuple[str, str, str, str] = ("text_score", "meta_score", "score", "kept"), least: float = 0.5) -> DataFrame:
    """docs with P(good) by text, by metadata and by both, and whether the last is at least least."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # WORDS + META numbers
    read = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    whole = [F.col(c).cast(k).alias(distinct_name(docs, f"_{c}")) for c, k in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "bigint")) if c in read]
    temporary = [distinct_name(docs, f"_{c}") for c in read]
    rows, passed = docs.select("*", *whole), docs.columns
    out = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:3]), T.StructField(names[3], T.BooleanType())])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        judge = sent.value.scorer()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = {c: batch.column(t).to_pylist() for c, t in zip(read, temporary, strict=True)}
            none = [None] * batch.num_rows
            found = [judge(*r) for r in zip(*(own.get(c, none) for c in ("text", "source", "lang", "n_chars")), strict=True)]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(3)] + [pa.array([f[2] >= least for f in found], pa.bool_())]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(passed))), *columns], names=[*passed, *names])

        return each

    return map_batches(rows, out, make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_score, meta_score, score (P(good) each), kept (score of at least 0.5).

    A document is good if it is labelled neither toxic nor of low quality; of
    several labels for a document the worst counts. Null texts count as empty,
    null or missing metadata as a value of its own. Without labelled documents
    of both kinds every score is the share of good ones (1 without any).
    Repeated rows are scored each; empty tables give no rows.
    """
    return score(_columns(docs), fit(docs, labels)).select("doc_id", "text_score", "meta_score", "score", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects, all columns kept; judged where they are read."""
    names = tuple(distinct_name(docs, n) for n in ("_by_text", "_by_meta", "_by_both", "_kept"))
    return score(docs, fit(docs, labels), names).filter(F.col(names[3])).drop(*names)
