"""Near copies by BK-trees over SimHash and by MinHash, decided by the exact Jaccard similarity of five-word shingles.

Candidates come from BK-trees over SimHash fingerprints of the shingles (`simhash.links`):
texts whose fingerprints are joined by steps of three bits or fewer are a bucket.
Two texts of similarity 0.8 differ in about ten bits, beyond what such trees can ask
for, so MinHash bands give the rest: of BANDS bands of ROWS minima each, two texts
of similarity s agree on at least one with probability 1 - (1 - s^ROWS)^BANDS, 0.99995
at 0.8. Within a bucket texts are compared by their whole shingle sets, so nothing
below SIMILARITY is linked. Buckets with the same members are compared once.

A bucket with more than PART texts is dealt to parts. Each part compares its texts
with the bucket's pivot, the text of smallest hash; those alike are one component
through it. The others, few where a bucket is one group of near copies, are asked
of all parts, so that no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import simhash
from seqloom.llm.common import distinct_name, map_batches
from seqloom.operators.graph import connected_components
from seqloom.runtime import Scratch, attach, ship_package

SEED, SHINGLE = 42, 5
#: Texts of a bucket that are compared in one task.
PART = 2000
#: Least similarity, as a fraction, so that the test is exact in integers.
SIMILARITY = (4, 5)
BANDS, ROWS = 25, 5
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of word shingles, repeats included; fewer words than a shingle has make one, no words too."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of word shingles, ascending."""
    return np.unique(shingle_hashes(text))


def bands(own: np.ndarray) -> list[int]:
    """One number for each band: which, and its minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 2048):
        np.minimum(least, (own[start : start + 2048, None] * _FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def alike(own: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Places of the sets at least SIMILARITY like own."""
    num, den = SIMILARITY
    sizes = np.array([len(s) for s in sets], np.int64)
    may = np.flatnonzero(den * np.minimum(sizes, len(own)) >= num * np.maximum(sizes, len(own)))
    if not len(may):
        return may
    flat = np.concatenate([sets[k] for k in may])
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[place] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes[may])[:-1]])
    return may[den * both >= num * (sizes[may] + len(own) - both)]


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that connect all sets at least SIMILARITY alike."""
    left, found = np.arange(len(sets)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = left[alike(sets[at], [sets[k] for k in left])]
            found += [(at, int(k)) for k in near]
            reached += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return found


_LINKS = "u bigint, v bigint"


def _pairs(found: list[tuple]) -> pa.Table:
    return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})


def compare_all(key: tuple, members: pa.Table) -> pa.Table:
    texts = dict(zip(members.column("text_hash").to_pylist(), members.column("text").to_pylist(), strict=True))
    names = list(texts)
    return _pairs([(names[a], names[b]) for a, b in similar_pairs([shingles(t) for t in texts.values()])])


def compare_pivot(key: tuple, members: pa.Table) -> pa.Table:
    """Links to the pivot; a text that is not like it comes back linked to nothing."""
    rows = zip(members.column("text_hash").to_pylist(), members.column("text").to_pylist(), members.column("asks").to_pylist(), strict=True)
    texts = {h: (t, asks) for h, t, asks in sorted(rows, key=lambda r: (r[2], r[0]))}  # the pivot's own row gives way to the asking one
    pivot = next(h for h, (_, asks) in texts.items() if asks)
    names = [h for h in texts if h != pivot]
    near = {names[k] for k in alike(shingles(texts[pivot][0]), [shingles(texts[h][0]) for h in names])}
    return _pairs([(h, pivot if h in near else None) for h in names])


def compare_asked(key: tuple, members: pa.Table) -> pa.Table:
    """Links of the asking texts to those of this part: to others that ask, and to one that is like the pivot."""
    rows = zip(members.column("text_hash").to_pylist(), members.column("text").to_pylist(), members.column("asks").to_pylist(), strict=True)
    texts = {h: (t, asks) for h, t, asks in sorted(rows, key=lambda r: (r[2], r[0]))}
    names = list(texts)
    sets, asks = [shingles(t) for t, _ in texts.values()], np.array([a for _, a in texts.values()], bool)
    found, least = [], {h: h for h in names}

    def root(h: int) -> int:
        while least[h] != h:
            h = least[h]
        return h

    for k in np.flatnonzero(asks):
        near = alike(sets[k], sets)
        for j in [*near[asks[near]], *near[~asks[near]][:1]]:
            a, b = root(names[k]), root(names[j])
            if a != b:
                least[max(a, b)] = min(a, b)
                found.append((names[k], names[j]))
    return _pairs(found)


def tree_buckets(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_hash, bucket) of distinct rows (text_hash, fp): one bucket for all that BK-trees over the fingerprints join."""
    spark = prints.sparkSession
    prints = scratch.keep(prints, "prints")
    sizes = scratch.keep(prints.groupBy("fp").agg(F.count("*").alias("size")), "sizes")
    found = scratch.keep(simhash.links(sizes, scratch), "tree-links")
    joined = connected_components(spark, found, scratch).withColumnRenamed("node", "fp")
    groups = scratch.keep(sizes.join(joined, "fp", "left").select("fp", "size", F.coalesce("component", "fp").alias("component")), "groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return attach(prints, groups, "fp", "size", total).select("text_hash", F.xxhash64("component", F.lit(BANDS)).alias("bucket"))


def links(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): links between text hashes that connect all texts at least SIMILARITY alike. rows: doc_id, text, text_hash."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, found = [], []
            for text in batch.column("text").to_pylist():
                own = shingle_hashes(text)
                prints.append(simhash.of_hashes(own))
                found.append(bands(np.unique(own)))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column("text_hash"), fp, pa.array(found, pa.list_(pa.int64()))], names=["text_hash", "fp", "bands"])

        return each

    ship_package(rows.sparkSession)
    banded = scratch.keep(map_batches(rows.select("text", "text_hash"), "text_hash bigint, fp bigint, bands array<bigint>", make), "bands")
    near = scratch.keep(tree_buckets(banded.select("text_hash", "fp").distinct(), scratch), "trees")
    dealt = banded.select("text_hash", F.explode("bands").alias("bucket")).unionByName(near)
    one, two = F.xxhash64("text_hash"), F.xxhash64("text_hash", F.lit(1))
    buckets = dealt.distinct().groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two")).filter("members > 1")
    buckets = buckets.groupBy("members", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    # Of rows with equal texts the one with the smallest doc_id stands for all.
    one = rows.groupBy("text_hash").agg(F.min("doc_id").alias("least_id"))
    members = scratch.keep(dealt.join(buckets, "bucket").distinct().join(one, "text_hash"), "members")
    texts = rows.select("doc_id", "text", F.col("text_hash").alias("of_hash")).hint("merge")

    def with_text(some: DataFrame) -> DataFrame:
        return some.join(texts, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("least_id"))).select("bucket", "members", "text_hash", "text")

    few = with_text(members.filter(F.col("members") <= PART)).groupBy("bucket").applyInArrow(compare_all, _LINKS)
    many = members.filter(F.col("members") > PART)
    if many.isEmpty():
        return few
    parts = F.ceil(F.col("members") / PART).cast("bigint")
    own = scratch.keep(with_text(many).select("bucket", F.pmod(F.xxhash64("text_hash"), parts).alias("part"), "text_hash", "text", F.lit(False).alias("asks"), parts.alias("parts")), "parts")

    def asked(of: DataFrame) -> DataFrame:
        """The rows of the given texts' buckets, and the given ones once more for each part of their bucket."""
        there = own.join(of.select("bucket").distinct(), "bucket", "left_semi")
        every = of.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("asks", F.lit(True))
        return there.unionByName(every.select(own.columns)).drop("parts").groupBy("bucket", "part")

    pivots = own.groupBy("bucket").agg(F.min("text_hash").alias("text_hash"))
    first = scratch.keep(asked(own.join(pivots, ["bucket", "text_hash"])).applyInArrow(compare_pivot, _LINKS), "pivots")
    loose = own.join(first.filter("v IS NULL").select(F.col("u").alias("text_hash")).distinct(), "text_hash", "left_semi")
    return few.unionByName(first.filter("v IS NOT NULL")).unionByName(asked(loose).applyInArrow(compare_asked, _LINKS))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without those that links join to a smaller doc_id; all columns kept, as are rows without doc_id.

    Equal texts are linked too. Texts without words are alike, null ones included.
    """
    scratch = Scratch(docs.sparkSession, "near-text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    found = scratch.keep(links(rows, scratch), "links")
    joined = connected_components(docs.sparkSession, found, scratch)
    ids = scratch.keep(rows.select("doc_id", "text_hash").join(joined.withColumnRenamed("node", "text_hash"), "text_hash", "left").withColumn("component", F.coalesce("component", "text_hash")), "ids")
    least = ids.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).filter("size > 1")
    key_id, key_hash = distinct_name(docs, "gone_id"), distinct_name(docs, "gone_hash")
    gone = ids.join(least, "component").filter("doc_id <> least").select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct()
    gone = scratch.keep(gone, "gone")
    # A merge join whatever its size: a broadcast would end once many rows go, and disk then jumps.
    gone = gone.hint("merge")
    return docs.join(gone, (docs["doc_id"] == gone[key_id]) & (F.xxhash64(docs["text"].cast("string")) == gone[key_hash]), "left_anti")
