"""Token labelling: structural features, degradation, naive Bayes, Viterbi, metrics, permutation nulls, folds.

Lines are tokens with unit columns and pos; a token has form (null if damaged),
truth and family. Everything is counted by joins and aggregates; only the greedy
fold builder is sequential, over one row for each family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.hashing import event_uniform
from seqloom.runtime import Scratch, ship_package

FEATURES = (
    "position_bucket", "line_length_bucket", "reported_direction", "damage", "observation_status", "previous_equality",
    "next_equality", "line_frequency_bucket", "seen_before", "seen_after", "line_template",
)

# ---- features --------------------------------------------------------------------------------------------------------


def position_bucket(index: Column, length: Column) -> Column:
    return F.when(length == 1, "singleton").when(index == 1, "initial").when(index == length, "final").otherwise("medial")


def length_bucket(length: Column) -> Column:
    return F.when(length <= 7, length.cast("string")).otherwise("8_plus")


def equality(own: Column, other: Column, outside: Column, boundary: str) -> Column:
    return F.when(outside, boundary).when(own.isNull(), "current_missing").when(other.isNull(), "neighbor_missing").when(own == other, "same").otherwise("different")


def structural_features(tokens: DataFrame, line: list[str]) -> DataFrame:
    """tokens with the eleven features in FEATURES: none of them names a form, all compare forms within a line.

    All windows are over one line, so they share a single exchange by line.
    """
    own, ordered = W.partitionBy(*line), W.partitionBy(*line).orderBy("pos")
    same = W.partitionBy(*line, "form").orderBy("pos")
    rows = tokens.withColumn("__n", F.count("*").over(own)).withColumn("__first", F.when(F.col("form").isNotNull(), F.min("pos").over(W.partitionBy(*line, "form"))))
    code = F.dense_rank().over(own.orderBy(F.col("__first").asc_nulls_last())) - 1
    rows = rows.withColumn("__code", F.concat(F.when(F.col("damaged"), "damaged:").otherwise("clear:"), F.when(F.col("form").isNull(), "missing").otherwise(code.cast("string"))))
    known = F.col("form").isNotNull()
    uses, nth = F.count("form").over(W.partitionBy(*line, "form")), F.row_number().over(same)
    rows = rows.withColumns({
        "position_bucket": position_bucket(F.col("pos"), F.col("__n")),
        "line_length_bucket": length_bucket(F.col("__n")),
        "damage": F.when(F.col("damaged"), "damaged").otherwise("clear"),
        "observation_status": F.when(known, "observed").otherwise("missing"),
        "previous_equality": equality(F.col("form"), F.lag("form").over(ordered), F.col("pos") == 1, "BOS"),
        "next_equality": equality(F.col("form"), F.lead("form").over(ordered), F.col("pos") == F.col("__n"), "EOS"),
        "line_frequency_bucket": F.when(~known, "missing").when(uses <= 1, "once").when(uses == 2, "twice").otherwise("three_plus"),
        "seen_before": F.when(~known, "missing").when(nth > 1, "yes").otherwise("no"),
        "seen_after": F.when(~known, "missing").when(nth < uses, "yes").otherwise("no"),
    })
    template = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__code")).over(own)), lambda t: t["__code"]), ","), 256)
    return rows.withColumn("line_template", template).drop("__n", "__first", "__code")


# ---- degradation -----------------------------------------------------------------------------------------------------

#: Rates of each regime: longest line kept, then chances of reversal, unknown direction, a variant form, damage, a second copy.
REGIMES = {"clean": (None, 0.0, 0.0, 0.0, 0.0, 0.0), "mild": (7, 0.3, 0.1, 0.5, 0.15, 0.25), "harsh": (4, 0.5, 0.25, 0.5, 0.4, 0.5)}


def degrade(tokens: DataFrame, document: str, line: str, regime: str, seed: int = 0) -> DataFrame:
    """Degraded copies of tokens (document, line, pos, form): windows, reversal, variants, damage and replicas by event digests.

    The window of a long line lies around the token whose digest comes first. All
    chances are column expressions of ids alone, so any task gets the same result.
    """
    longest, reverse, unknown, variant, damage, duplicate = REGIMES[regime]
    own = W.partitionBy(document, line)
    doc, ln, at = F.col(document), F.col(line), F.col("pos") - 1
    rows = tokens.withColumn("__n", F.count("*").over(own))
    if longest is not None:
        digest = F.sha2(F.concat_ws("|", F.lit("window"), F.lit(str(seed)), doc.cast("string"), ln.cast("string"), at.cast("string")), 256)
        rows = rows.withColumn("__anchor", F.min_by(at, F.struct(digest, at)).over(own))
        left = F.least(F.greatest(F.col("__anchor") - (longest - 1) // 2, F.lit(0)), F.col("__n") - longest)
        rows = rows.filter((F.col("__n") <= longest) | ((at >= left) & (at < left + longest)))
    rows = rows.withColumns({
        "reversed": event_uniform("reverse", seed, doc, ln) < reverse,
        "unknown_direction": event_uniform("direction", seed, doc, ln) < unknown,
        "variant": event_uniform("variant", seed, doc, ln, at) < variant,
        "damaged": event_uniform("damage", seed, doc, ln, at) < damage,
        "replicas": F.when(event_uniform("duplicate", seed, doc) < duplicate, 2).otherwise(1),
    })
    order = F.row_number().over(own.orderBy(F.when(F.col("reversed"), -F.col("pos")).otherwise(F.col("pos"))))
    rows = rows.withColumn("visual_index", order - 1)
    shown = F.when(F.col("variant"), F.concat("form", F.lit("~"), (F.col("pos") % 3).cast("string"))).otherwise(F.col("form"))
    rows = rows.withColumn("observed_form", F.when(~F.col("damaged"), shown))
    return rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("replicas") - 1))).drop("__n", "__anchor", "replicas")


# ---- naive Bayes -------------------------------------------------------------------------------------------------------


def family_weights(tokens: DataFrame, family: str) -> DataFrame:
    """tokens with weight: every family has the same total."""
    return tokens.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy(family)))


def class_masses(train: DataFrame) -> DataFrame:
    return train.groupBy("truth").agg(F.sum("weight").alias("class_mass"))


def feature_masses(train: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, truth, mass): weighted counts, pre-aggregated before any exchange."""
    return train.unpivot(["truth", "weight"], features, "feature", "value").groupBy("feature", "value", "truth").agg(F.sum("weight").alias("mass"))


def bayes_scores(test: DataFrame, train: DataFrame, features: list[str], key: list[str], classes: list[str]) -> DataFrame:
    """key columns, truth and predicted: categorical naive Bayes with one more value than seen for each feature.

    Masses become one row for each (feature, value) with a column for each class,
    so a test token meets each of its features once. Ties go to the class named first.
    """
    masses = class_masses(train)
    priors = masses.agg(*(F.coalesce(F.sum(F.when(F.col("truth") == c, F.col("class_mass"))), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(classes)), F.sum("class_mass").alias("total"))
    by_value = feature_masses(train, features)
    sizes = by_value.groupBy("feature").agg(F.count_distinct("value").alias("v"))
    wide = by_value.groupBy("feature", "value").agg(*(F.coalesce(F.sum(F.when(F.col("truth") == c, F.col("mass"))), F.lit(0.0)).alias(f"f{k}") for k, c in enumerate(classes)))
    long = test.unpivot([*key, "truth"], features, "feature", "value")
    # A row for each feature, and one row of priors.
    joined = long.join(F.broadcast(sizes), "feature").join(wide, ["feature", "value"], "left").crossJoin(F.broadcast(priors))
    term = lambda k: F.ln((F.coalesce(f"f{k}", F.lit(0.0)) + 1.0) / (F.col(f"m{k}") + F.col("v") + 1))
    sums = joined.groupBy(*key, "truth").agg(*((F.sum(term(k)) + F.first(F.ln((F.col(f"m{k}") + 1.0) / (F.col("total") + len(classes))))).alias(f"s{k}") for k in range(len(classes))))
    ranked = F.array(*(F.struct(F.round(f"s{k}", 9).alias("s"), F.lit(-k).alias("tie"), F.lit(c).alias("c")) for k, c in enumerate(classes)))
    return sums.select(*key, "truth", F.array_max(ranked)["c"].alias("predicted"))


def majority(train: DataFrame) -> DataFrame:
    """The class with the largest mass, by name among equals: one row."""
    return class_masses(train).agg(F.max_by("truth", F.struct(F.round("class_mass", 9).alias("m"), F.translate("truth", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("predicted"))


# ---- transitions and decoding ------------------------------------------------------------------------------------------


def transition_matrix(tokens: DataFrame, line: list[str], classes: list[str]) -> DataFrame:
    """(previous, following, mass, log_probability) with Laplace's rule over all pairs of classes."""
    before = F.lag("truth").over(W.partitionBy(*line).orderBy("pos"))
    pairs = tokens.withColumn("previous", before).filter("previous IS NOT NULL").groupBy("previous", F.col("truth").alias("following")).agg(F.sum("weight").alias("mass"))
    spark = tokens.sparkSession
    every = spark.createDataFrame([(a, b) for a in classes for b in classes], "previous string, following string")  # classes squared
    full = every.join(pairs, ["previous", "following"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    row = F.sum("mass").over(W.partitionBy("previous"))
    return full.withColumn("log_probability", F.ln((F.col("mass") + 1.0) / (row + len(classes))))


def start_masses(tokens: DataFrame, line: list[str], family: str, classes: list[str]) -> DataFrame:
    """(truth, mass, log_probability): how often lines start in each class, each family's lines sharing a weight of one; Laplace's rule."""
    starts = tokens.filter("pos = 1").select(family, *line, "truth")
    weighted = starts.join(starts.groupBy(family).agg((F.lit(1.0) / F.count("*")).alias("__share")), family)
    masses = weighted.groupBy("truth").agg(F.sum("__share").alias("mass"))
    every = tokens.sparkSession.createDataFrame([(c,) for c in classes], "truth string")  # the classes
    full = every.join(masses, "truth", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    total = full.agg(F.sum("mass").alias("__total"))
    return full.crossJoin(F.broadcast(total)).withColumn("log_probability", F.ln((F.col("mass") + 1.0) / (F.col("__total") + len(classes)))).drop("__total")  # one row


def class_balance(masses: DataFrame, gamma: float) -> DataFrame:
    """(truth, class_mass, multiplier): (mean mass / own mass)^gamma, scaled so that the total mass stays as it is."""
    sums = masses.agg(F.sum("class_mass").alias("__total"), F.count("*").alias("__classes"))
    raw = masses.crossJoin(F.broadcast(sums)).withColumn("__raw", F.pow(F.col("__total") / F.col("__classes") / F.col("class_mass"), F.lit(gamma)))  # one row
    adjusted = raw.agg((F.max("__total") / F.sum(F.col("class_mass") * F.col("__raw"))).alias("__scale"))
    return raw.crossJoin(F.broadcast(adjusted)).select("truth", "class_mass", (F.col("__raw") * F.col("__scale")).alias("multiplier"))  # one row


def movable(units: DataFrame, unit: str) -> DataFrame:
    """One row (units, movable, fraction): how many units share their size with another, so that a permutation can move their labels."""
    strata = units.groupBy(unit).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    moved = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return strata.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units"), moved.alias("movable"), (moved / F.sum("n")).alias("fraction"))


def viterbi(emissions: Column, start: Column, transition: Column, strength: float, states: int) -> Column:
    """Best path (state numbers from 0) of an array of emission arrays, folded inside the JVM; ties keep the lower state.

    start: array of log-probabilities; transition: array of rows. The fold carries
    each state's score and path, so a line's work is its length times states squared.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.struct((F.element_at(F.element_at(emissions, 1), s + 1) + strength * F.element_at(start, s + 1)).alias("score"), F.array(s).alias("path")))

    def best(acc: Column, state: Column, emission: Column) -> Column:
        options = F.transform(
            acc,
            lambda a, i: F.struct((a["score"] + strength * F.element_at(F.element_at(transition, i + 1), state + 1)).alias("score"), (-i).alias("tie"), a["path"].alias("path")),
        )
        top = F.array_max(options)
        return F.struct((top["score"] + F.element_at(emission, state + 1)).alias("score"), F.concat(top["path"], F.array(state)).alias("path"))

    folded = F.aggregate(
        F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0))), first, lambda acc, e: F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: best(acc, s, e))
    )
    return F.array_max(F.transform(folded, lambda a, i: F.struct(a["score"].alias("score"), (-i).alias("tie"), a["path"].alias("path"))))["path"]


# ---- metrics -------------------------------------------------------------------------------------------------------------


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(truth, predicted, mass): a partial result may be unioned with others and summed again."""
    return rows.groupBy(*(by or []), "truth", "predicted").agg(F.sum("weight").alias("mass"))


def class_metrics(matrix: DataFrame, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """(truth, truth_mass, predicted_mass, precision, recall, f1) for each class; recall is null for a class without mass."""
    by = by or []
    long = matrix.select(*by, "mass", "truth", "predicted", F.explode(F.array(*(F.lit(c) for c in classes))).alias("class"))
    sums = long.groupBy(*by, "class").agg(
        F.coalesce(F.sum(F.when((F.col("truth") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("mass"))), F.lit(0.0)).alias("hit"),
        F.coalesce(F.sum(F.when(F.col("truth") == F.col("class"), F.col("mass"))), F.lit(0.0)).alias("truth_mass"),
        F.coalesce(F.sum(F.when(F.col("predicted") == F.col("class"), F.col("mass"))), F.lit(0.0)).alias("predicted_mass"),
    )
    precision = F.when(F.col("predicted_mass") > 0, F.col("hit") / F.col("predicted_mass")).otherwise(0.0)
    recall = F.when(F.col("truth_mass") > 0, F.col("hit") / F.col("truth_mass"))
    rated = sums.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.coalesce("recall", F.lit(0.0)) > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rated.withColumn("f1", f1)


def summary_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and worst recall; macro values are null if a class has no truth."""
    whole = F.count_if(F.col("truth_mass") <= 0) == 0
    return metrics.groupBy(*(by or [])).agg(
        (F.sum("hit") / F.sum("truth_mass")).alias("accuracy"), F.when(whole, F.avg("recall")).alias("balanced_accuracy"), F.when(whole, F.avg("f1")).alias("macro_f1"), F.when(whole, F.min("recall")).alias("worst_recall")
    )


def family_coverage(tokens: DataFrame, family: str) -> DataFrame:
    """(truth, coverage): the mean over families of the share of a class's tokens whose form can be read."""
    each = tokens.groupBy(family, "truth").agg((F.count("form") / F.count("*")).alias("share"))
    return each.groupBy("truth").agg(F.avg("share").alias("coverage"))


# ---- permutation null -----------------------------------------------------------------------------------------------------


def permuted_labels(train: DataFrame, family: str, runs: int, order: list[str]) -> DataFrame:
    """train once for each run, the families of equal size having exchanged their label vectors.

    In each (run, size) recipients stand in order of their keys, donors in order of
    their digests. Windows hold one row for each family of a size, not its tokens.
    """
    spark = train.sparkSession
    placed = train.withColumn("__i", F.row_number().over(W.partitionBy(family).orderBy(*order)))
    sizes = placed.groupBy(family).agg(F.count("*").alias("__size"))
    every = sizes.crossJoin(F.broadcast(spark.range(runs).withColumnRenamed("id", "run")))
    digest = F.sha2(F.concat_ws("|", F.col("run").cast("string"), F.col("__size").cast("string"), F.col(family)), 256)
    stratum = W.partitionBy("run", "__size")
    recipients = every.withColumn("__n", F.row_number().over(stratum.orderBy(family)))
    donors = every.withColumn("__n", F.row_number().over(stratum.orderBy(digest, family))).select("run", "__size", "__n", F.col(family).alias("__donor"))
    pairs = recipients.join(donors, ["run", "__size", "__n"]).select("run", family, "__donor")
    labels = placed.select(F.col(family).alias("__donor"), "__i", F.col("truth").alias("__label"))
    return placed.join(pairs, family).join(labels, ["__donor", "__i"]).withColumn("truth", F.col("__label")).drop("__label", "__donor", "__i")


# ---- folds -------------------------------------------------------------------------------------------------------------------


def family_support(tokens: DataFrame, family: str, classes: list[str]) -> DataFrame:
    """A row for each family with its token count of each class."""
    return tokens.groupBy(family).pivot("truth", classes).agg(F.count(F.lit(1))).na.fill(0)


def _folder(family: str, classes: list[str], folds: int, domain: str, by: str) -> Callable[[pa.Table], pa.Table]:
    """What deals one table of families to folds; by names a column that is the same in all its rows."""

    def one(rows: pa.Table) -> pa.Table:
        names = rows.column(family).to_pylist()
        counts = dict(zip(names, zip(*(rows.column(c).to_pylist() for c in classes), strict=True), strict=True))
        tokens = [sum(v[k] for v in counts.values()) for k in range(len(classes))]
        support_of = [sum(v[k] > 0 for v in counts.values()) for k in range(len(classes))]
        if min(support_of) < folds:
            raise ValueError("each class needs at least as many families as there are folds")

        def turn(name: str) -> tuple:
            own = [k for k, n in enumerate(counts[name]) if n]
            shares = [Fraction(counts[name][k], tokens[k]) for k in own]
            digest = hashlib.sha256(f"{domain}|{name}".encode()).digest()
            return min((support_of[k] for k in own), default=0), -max(shares, default=Fraction()), -sum(shares, Fraction()), -len(own), -sum(counts[name]), digest, name

        held = [[0] * len(classes) for _ in range(folds)]
        present = [[0] * len(classes) for _ in range(folds)]
        size, left, placed = [0] * folds, list(support_of), {}

        def uneven(matrix: list[list[int]], totals: list[int]) -> tuple[Fraction, Fraction]:
            off = [Fraction(abs(row[k] * folds - t), t) for row in matrix for k, t in enumerate(totals) if t]
            return max(off), sum((x * x for x in off), Fraction())

        for name in sorted(counts, key=turn):
            own = counts[name]
            left = [n - (own[k] > 0) for k, n in enumerate(left)]
            best = None
            for f in range(folds):
                held_f = [[n + own[k] if g == f else n for k, n in enumerate(row)] for g, row in enumerate(held)]
                empty = [sum(row[k] == 0 for row in held_f) for k in range(len(classes))]
                if any(e > n for e, n in zip(empty, left, strict=True)):
                    continue
                present_f = [[n + (own[k] > 0) if g == f else n for k, n in enumerate(row)] for g, row in enumerate(present)]
                cost = (sum(empty), *uneven(held_f, tokens), *uneven(present_f, support_of), *uneven([[n + (g == f)] for g, n in enumerate(size)], [len(counts)]), f)
                if best is None or cost < best[0]:
                    best = (cost, held_f, present_f)
            if best is None:
                raise ValueError("no fold keeps support for every class")
            cost, held, present = best
            placed[name] = cost[-1]
            size[cost[-1]] += 1
        return pa.table({by: pa.array([rows.column(by)[0].as_py()] * len(placed), pa.int32()), family: pa.array(list(placed), pa.string()), "fold": pa.array(list(placed.values()), pa.int32())})

    return one


def greedy_folds(support: DataFrame, family: str, classes: list[str], folds: int, domain: str = "outer") -> DataFrame:
    """(family, fold): balanced folds in which every class keeps support, by exact fractions.

    Families with rare classes and large shares go first. Each goes where, in this
    order, fewest (fold, class) cells stay empty, then tokens, family presence and
    fold sizes are least uneven; the lower fold wins ties. The choice depends on all
    earlier ones, so one task works through the table of families, which is small.
    """
    ship_package(support.sparkSession)

    whole = _support_table(support, family, classes).withColumn("__all", F.lit(0))
    return whole.groupBy("__all").applyInArrow(_folder(family, classes, folds, domain, "__all"), f"__all int, {family} string, fold int").drop("__all")


def _support_table(support: DataFrame, family: str, classes: list[str]) -> DataFrame:
    return support.select(F.col(family).cast("string").alias(family), *(F.col(c).cast("bigint").alias(c) for c in classes))


def nested_folds(support: DataFrame, family: str, classes: list[str], outer: int = 5, inner: int = 4) -> DataFrame:
    """(outer, family, inner): inner is null for the families that the outer fold holds out, else their fold among the rest."""
    ship_package(support.sparkSession)
    scratch = Scratch(support.sparkSession, "folds")
    placed = scratch.keep(greedy_folds(support, family, classes, outer, "outer"), "outer")
    every = placed.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    rest = every.filter("fold <> outer").join(_support_table(support, family, classes), family)
    dealt = rest.groupBy("outer").applyInArrow(_folder(family, classes, inner, "inner", "outer"), f"outer int, {family} string, fold int")
    return every.filter("fold = outer").select("outer", family, F.lit(None).cast("int").alias("inner")).unionByName(dealt.withColumnRenamed("fold", "inner"))


def one_standard_error(scores: DataFrame) -> DataFrame:
    """The simplest candidate within one standard error of the best mean, from (candidate, complexity, fold, score)."""
    each = scores.groupBy("candidate", "complexity").agg(F.avg("score").alias("mean"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("se"))
    each = each.withColumn("m", F.round("mean", 9))
    best = each.agg(F.max_by(F.struct("mean", "se"), F.struct("m", (-F.col("complexity")).alias("c"))).alias("best")).select((F.col("best.mean") - F.col("best.se")).alias("cutoff"))
    return each.crossJoin(F.broadcast(best)).filter("mean >= cutoff").orderBy("complexity", F.desc("m"), "candidate").limit(1).select("candidate", "complexity", "mean", "cutoff")


# ---- profiles ----------------------------------------------------------------------------------------------------------------


def type_profiles(tokens: DataFrame, line: list[str], family: str) -> DataFrame:
    """Per form and family, the form's profile over all other families: totals less the family's own part.

    One pass gives each (form, family) part; a window over a form's families gives
    the totals. No family is ever recomputed from all others.
    """
    own = W.partitionBy(*line)
    rows = tokens.withColumn("__n", F.count("*").over(own)).filter("form IS NOT NULL")
    at = F.when(F.col("__n") == 1, 0.5).otherwise((F.col("pos") - 1) / (F.col("__n") - 1))
    parts = rows.withColumn("at", at).groupBy("form", family).agg(
        F.count("*").alias("n"), F.sum("at").alias("s1"), F.sum(F.col("at") * F.col("at")).alias("s2"), F.count_if(F.col("pos") == 1).alias("initial"), F.count_if(F.col("pos") == F.col("__n")).alias("final")
    )
    form = W.partitionBy("form")
    others = {c: (F.sum(c).over(form) - F.col(c)) for c in ("n", "s1", "s2", "initial", "final")}
    out = parts.select("form", family, F.col("n").alias("own_n"), *(v.alias(f"o_{c}") for c, v in others.items()))
    mean = F.col("o_s1") / F.col("o_n")
    return out.filter("o_n > 0").select(
        "form", family, "own_n", F.col("o_n").alias("support"), mean.alias("mean_position"), F.greatest(F.lit(0.0), F.col("o_s2") / F.col("o_n") - mean * mean).alias("position_variance"),
        (F.col("o_initial") / F.col("o_n")).alias("initial_rate"), (F.col("o_final") / F.col("o_n")).alias("final_rate"),
    )


def context_entropy(tokens: DataFrame, line: list[str]) -> DataFrame:
    """(form, entropy) of what stands before each form, in nats."""
    before = F.coalesce(F.lag("form").over(W.partitionBy(*line).orderBy("pos")), F.lit("BOS"))
    counts = tokens.withColumn("before", before).filter("form IS NOT NULL").groupBy("form", "before").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("form"))
    return counts.withColumn("t", -p * F.ln(p)).groupBy("form").agg(F.sum("t").alias("entropy"))


# ---- gates -------------------------------------------------------------------------------------------------------------------


def gates(values: DataFrame, thresholds: list[tuple[str, str, float]], tolerance: float = 0.0) -> DataFrame:
    """(metric, value, relation, threshold, passed) of one row of values; relation is >=, > or <=."""
    spark = values.sparkSession
    limits = spark.createDataFrame(thresholds, "metric string, relation string, threshold double")  # a row for each gate
    long = values.unpivot([], [m for m, _, _ in thresholds], "metric", "value")
    v, t = F.col("value"), F.col("threshold")
    passed = F.when(F.col("relation") == ">=", v >= t - tolerance).when(F.col("relation") == ">", v > t + tolerance).otherwise(v <= t + tolerance)
    return long.join(F.broadcast(limits), "metric").withColumn("passed", F.coalesce(passed, F.lit(False)))


def decision(gated: DataFrame) -> DataFrame:
    return gated.agg(F.bool_and("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failed")).withColumn("status", F.when(F.col("all_passed"), "qualified").otherwise("not_qualified"))
