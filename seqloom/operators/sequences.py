"""Sequences of signs from tables and nested artifacts: unnesting, reading order, gaps, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.text import UNREADABLE, stable_text

BACKWARDS = ("right_to_left", "bottom_to_top")


def number_or_null(value: Column) -> Column:
    """The number in a numeric or numeric-text index, null for all else (truth values included)."""
    text = F.trim(value.cast("string"))
    return F.when(~text.isin("true", "false"), text.try_cast("double"))


def slots(tokens: Column, direction: Column) -> Column:
    """Signs of an array of token structs in reading order, null where unreadable.

    reading_index decides where every token has a numeric one; else visual_index
    where every token has one, turned round for lines that run backwards; else
    the order stored. Equal indices keep the stored order.
    """
    placed = F.transform(
        tokens,
        lambda t, i: F.struct(
            number_or_null(t["reading_index"]).alias("r"), number_or_null(t["visual_index"]).alias("v"), i.alias("i"), stable_text(t["sign_id"]).alias("sign")
        ),
    )
    by_reading = F.transform(F.array_sort(F.transform(placed, lambda t: F.struct(t["r"].alias("k"), t["i"].alias("i"), t["sign"].alias("sign")))), lambda t: t["sign"])
    by_sight = F.transform(F.array_sort(F.transform(placed, lambda t: F.struct(t["v"].alias("k"), t["i"].alias("i"), t["sign"].alias("sign")))), lambda t: t["sign"])
    return (
        F.when(F.forall(placed, lambda t: t["r"].isNotNull()), by_reading)
        .when(F.forall(placed, lambda t: t["v"].isNotNull()), F.when(direction.isin(*BACKWARDS), F.reverse(by_sight)).otherwise(by_sight))
        .otherwise(F.transform(placed, lambda t: t["sign"]))
    )


def lines(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, side_no, line_no, slots) of nested artifacts; records that hold lines or tokens at the top work too."""
    names = set(artifacts.columns)
    if "sides" in names:
        own = artifacts.select("artifact_id", F.posexplode("sides").alias("side_no", "side")).select("artifact_id", "side_no", F.posexplode("side.lines").alias("line_no", "line"))
    elif "lines" in names:
        own = artifacts.select("artifact_id", F.lit(0).alias("side_no"), F.posexplode("lines").alias("line_no", "line"))
    else:
        direction = F.col("reading_direction") if "reading_direction" in names else F.lit(None).cast("string")
        own = artifacts.select("artifact_id", F.lit(0).alias("side_no"), F.lit(0).alias("line_no"), F.struct("tokens", direction.alias("reading_direction")).alias("line"))
    return own.select("artifact_id", "side_no", "line_no", slots(F.col("line.tokens"), F.col("line.reading_direction")).alias("slots"))


def fingerprint(line_slots: Column) -> Column:
    """A line's signs with unreadable ones filled in; null if none can be read."""
    return F.when(F.exists(line_slots, lambda s: s.isNotNull()), F.transform(line_slots, lambda s: F.coalesce(s, F.lit(UNREADABLE))))


def segment_arrays(line_slots: Column) -> Column:
    """Runs of readable signs between unreadable ones, as an array of arrays."""
    start = F.array(F.array().cast("array<string>"))
    cut = F.aggregate(
        line_slots,
        start,
        lambda acc, s: F.when(s.isNull(), F.concat(acc, F.array(F.array().cast("array<string>")))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(s))))
        ),
    )
    return F.filter(cut, lambda run: F.size(run) > 0)


def positions(tokens: DataFrame, unit: list[str], order: list[str]) -> DataFrame:
    """tokens with pos: 1, 2, ... within each unit."""
    return tokens.withColumn("pos", F.row_number().over(W.partitionBy(*unit).orderBy(*order)))


def segments(tokens: DataFrame, unit: list[str]) -> DataFrame:
    """Readable tokens with seg, which a null sign ends, and idx within it. Both windows share the unit's partitioning."""
    own = W.partitionBy(*unit)
    cut = tokens.withColumn("seg", F.sum(F.when(F.col("sign").isNull(), 1).otherwise(0)).over(own.orderBy("pos")))
    return cut.filter("sign IS NOT NULL").withColumn("idx", F.row_number().over(W.partitionBy(*unit, "seg").orderBy("pos")))


def regroup_lines(tokens: DataFrame, unit: list[str], key: str) -> DataFrame:
    """tokens with line_ordinal: runs of equal keys in pos order; returned says whether a key came back after its run ended (an error)."""
    own = W.partitionBy(*unit).orderBy("pos")
    run = tokens.withColumn("__new", F.when(F.col(key).eqNullSafe(F.lag(key).over(own)) & F.col(key).isNotNull(), 0).otherwise(1))
    run = run.withColumn("line_ordinal", F.sum("__new").over(own)).drop("__new")
    runs = F.max("line_ordinal").over(W.partitionBy(*unit, key)) - F.min("line_ordinal").over(W.partitionBy(*unit, key))
    return run.withColumn("returned", F.col(key).isNotNull() & (runs > 0))


def length_policy(sequences: DataFrame, column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Sequences of at least so many signs, and one row of counts before, excluded and after."""
    n = F.size(column)
    kept = n >= least
    report = sequences.agg(
        F.count("*").alias("sequences_before"),
        F.coalesce(F.sum(n), F.lit(0)).alias("tokens_before"),
        F.count_if(~kept).alias("sequences_excluded"),
        F.coalesce(F.sum(F.when(~kept, n)), F.lit(0)).alias("tokens_excluded"),
        F.count_if(kept).alias("sequences_after"),
        F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).alias("tokens_after"),
    )
    return sequences.filter(kept), report
