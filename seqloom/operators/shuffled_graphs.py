"""Adjacency graphs of many shuffled corpora, without a row for each token of each run.

The permutations are those of nulls.shuffle_signs: places in the order of their key
take the signs in the order of a digest of run and key. Signs travel as codes of one,
two or four bytes, in blobs:

1. each donor's digests of all runs at once are dealt to buckets by their first bits;
2. a bucket of one run is sorted, so the run's buckets one after another hold the signs
   in the order of their places;
3. blocks of places turn that over: one row for each place with its codes of all runs;
4. places are put into reading order once for all runs, and neighbours give the edges.

No task holds a run's corpus: buckets, blocks and slices are of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.nulls import run_digest
from seqloom.operators.ranking import numbered
from seqloom.runtime import Scratch, free_shuffles, remove, ship_package

#: Donors whose digests one task deals at once, of a bucket on average, and places of a block.
SLICE = 1 << 17
BUCKET = 1 << 18
BLOCK = 1 << 16
#: Of so many runs whose codes are kept, one in DEALT has its digests shuffled at once: these are larger by as much.
DEALT = 5
#: Edges a task holds back to leave out those it has seen; up to 16 times as many possible ones are ticked off instead.
HELD = 1 << 22
#: Bytes of a digest that order donors; two of a billion donors agree in all of them once in 10**11 runs.
DIGEST = 12


def shuffled_adjacency(tokens: DataFrame, key: str, sequence: list[str], runs: int, at_once: int, scratch: Scratch, name: str = "runs") -> DataFrame:
    """Edges (run, u < v) of signs that stand side by side in each of runs 0, 1, ... of shuffled tokens.

    Tokens are ordered by idx in a sequence; null signs stay where they are and part
    their neighbours. Rows of equal keys are numbered by sequence and idx, and their
    signs, whose digests are equal too, go in lexical order. at_once bounds the tokens of all
    runs that lie on disk at a time.
    """
    spark = tokens.sparkSession
    ship_package(spark)
    # The signs are a vocabulary, whose graphs are one task's work each.
    signs = [r.sign for r in tokens.select("sign").filter("sign IS NOT NULL").distinct().orderBy("sign").collect()]
    vocabulary = spark.createDataFrame(list(enumerate(signs)), "code bigint, sign string")
    kind = next(k for k in ("u1", "u2", "u4") if len(signs) <= 1 << 8 * np.dtype(k).itemsize)
    alone = F.lag("sign").over(W.partitionBy(*sequence).orderBy("idx")).isNull()
    known = tokens.withColumn("alone", alone).join(F.broadcast(vocabulary), "sign").select(key, *sequence, "idx", "alone", "code")
    places = numbered(known, [F.col(c) for c in (key, *sequence, "idx")], "n", scratch)
    total = places.count()
    edges = spark.createDataFrame([], "run bigint, u string, v string")
    if not total:
        return edges
    slices = max(spark.sparkContext.defaultParallelism, -(-total // SLICE))
    donors = scratch.keep(places.select(F.col(key).cast("string").alias(key), "code").repartition(slices), "donors")
    wide = max(1, at_once // total)
    for first in range(0, runs, wide):
        own = Scratch(spark, name)
        part = range(first, min(first + wide, runs))
        ranked, step = None, max(1, len(part) // DEALT)
        for k in range(0, len(part), step):
            one = own.keep(_ranked(donors, key, part[k : k + step], total, kind), "ranked")
            ranked = one if ranked is None else ranked.unionByName(one)
            free_shuffles(spark)
        pairs = _pairs(_by_place(ranked, part, kind).join(places.select("n", *sequence, "idx", "alone"), "n"), sequence, part, len(signs), kind)
        ends = [F.broadcast(vocabulary.select(F.col("code").alias(c), F.col("sign").alias(e))) for c, e in (("low", "u"), ("high", "v"))]
        edges = edges.unionByName(scratch.keep(pairs.distinct().join(ends[0], "low").join(ends[1], "high").select("run", "u", "v"), "edges"))
        remove(spark, own.root)
        if first + wide < runs:
            free_shuffles(spark)
    return edges


def _record(kind: str) -> np.dtype:
    return np.dtype([("digest", "u8"), ("more", "u4"), ("code", kind)])


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end after so many bytes of data."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ranked(donors: DataFrame, key: str, runs: range, total: int, kind: str) -> DataFrame:
    """(run, bucket, size, codes): the codes of a run's donors in the order of their digests, bucket after bucket."""
    bits = min(16, max(0, (total - 1) // BUCKET).bit_length())
    record = _record(kind)
    # Bytes are cut off faster than characters, which are counted.
    digests = F.unhex(F.concat(*(F.substring(run_digest(F.lit(run), F.col(key)).cast("binary"), 1, 2 * DIGEST) for run in runs)).cast("string"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[pa.Table]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= SLICE:
                    yield pa.Table.from_batches(held)
                    held = []
            if held:
                yield pa.Table.from_batches(held)

        for table in slices():
            found = np.frombuffer(b"".join(table.column("digests").to_pylist()), [("digest", ">u8"), ("more", ">u4")]).reshape(table.num_rows, len(runs))
            rows = np.empty(table.num_rows, record)
            rows["code"] = table.column("code").to_numpy()
            for k, run in enumerate(runs):
                rows["digest"], rows["more"] = found["digest"][:, k], found["more"][:, k]
                bucket = (rows["digest"] >> np.uint64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(rows), np.uint16)
                counts = np.bincount(bucket)
                there = np.flatnonzero(counts)
                blobs = _blobs(rows[np.argsort(bucket, kind="stable")].view(np.uint8), np.cumsum(counts[there]) * record.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), run, np.int64)), pa.array(there.astype(np.int64)), blobs], ["run", "bucket", "rows"])

    def order(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), record)
        digest = np.ascontiguousarray(rows["digest"])
        at = np.argsort(digest)
        if (digest[at[1:]] == digest[at[:-1]]).any():
            at = np.lexsort((rows["code"], rows["more"], digest))
        codes = pa.array([rows["code"][at].tobytes()], pa.binary())
        return pa.table({"run": table.column("run").slice(0, 1), "bucket": table.column("bucket").slice(0, 1), "size": pa.array([len(rows)], pa.int64()), "codes": codes})

    dealt = donors.select(digests.alias("digests"), "code").mapInArrow(deal, "run bigint, bucket bigint, rows binary")
    return dealt.groupBy("run", "bucket").applyInArrow(order, "run bigint, bucket bigint, size bigint, codes binary")


def _by_place(ranked: DataFrame, runs: range, kind: str) -> DataFrame:
    """(n, codes): the codes of all runs at each place, one after another."""
    width, block = np.dtype(kind).itemsize, BLOCK
    # A bucket of a run is one row, so this window and what is broadcast are small.
    before = F.sum("size").over(W.partitionBy("run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = ranked.select("run", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    cut = ranked.join(F.broadcast(starts), ["run", "bucket"]).select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    cut = cut.withColumn("low", F.greatest("start", F.col("block") * block)).withColumn("high", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    piece = F.expr(f"substring(codes, int((low - start) * {width} + 1), int((high - low) * {width}))")
    pieces = cut.select("block", "run", (F.col("low") - F.col("block") * block).alias("at"), piece.alias("piece"))
    first, many = runs[0], len(runs)

    def turn(table: pa.Table) -> pa.Table:
        found = list(zip(table.column("run").to_pylist(), table.column("at").to_pylist(), (np.frombuffer(p, kind) for p in table.column("piece").to_pylist()), strict=True))
        codes = np.zeros((max(at + len(p) for _, at, p in found), many), kind)
        for run, at, p in found:
            codes[at : at + len(p), run - first] = p
        n = table.column("block")[0].as_py() * block + 1 + np.arange(len(codes))
        return pa.table({"n": pa.array(n), "codes": _blobs(codes.view(np.uint8), (1 + np.arange(len(codes))) * many * width)})

    return pieces.groupBy("block").applyInArrow(turn, "n bigint, codes binary")


def _pairs(placed: DataFrame, sequence: list[str], runs: range, signs: int, kind: str) -> DataFrame:
    """(run, low, high): codes that stand side by side; each task leaves out most of those it has seen."""
    first, many = runs[0], len(runs)

    def flat(keys: np.ndarray) -> pa.RecordBatch:
        rest, high = np.divmod(keys, signs)
        run, low = np.divmod(rest, signs)
        return pa.RecordBatch.from_arrays([pa.array(run + first), pa.array(low), pa.array(high)], ["run", "low", "high"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.arange(many, dtype=np.int64) * signs
        last = np.zeros((1, many), kind)
        held = [np.zeros(0, np.int64)]
        possible = many * signs * signs
        seen = np.zeros(possible, bool) if possible <= 16 * HELD else None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.concatenate([last, np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind).reshape(-1, many)])
            low, high = np.minimum(codes[1:], codes[:-1]), np.maximum(codes[1:], codes[:-1])
            # A partition holds whole sequences, so its first row has no neighbour before it.
            near = ~batch.column("alone").to_numpy(zero_copy_only=False)[:, None] & (low != high)
            keys = ((base + low) * signs + high)[near]
            last = codes[-1:]
            if seen is not None:
                seen[keys] = True
                continue
            held.append(np.unique(keys))
            if sum(map(len, held)) >= HELD:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) >= HELD // 2:
                    yield flat(held.pop())
                    held = [np.zeros(0, np.int64)]
        yield flat(np.unique(np.concatenate(held)) if seen is None else np.flatnonzero(seen))

    ordered = placed.repartition(*sequence).sortWithinPartitions(*sequence, "idx").select("alone", "codes")
    return ordered.mapInArrow(pair, "run bigint, low bigint, high bigint")
