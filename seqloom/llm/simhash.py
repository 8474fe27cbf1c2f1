"""SimHash near-duplicates linked through BK-trees.

Every document gets a 64-bit fingerprint. Distinct fingerprints are dealt to
shards by pairs of bit blocks: with five blocks, two fingerprints that differ in
at most three bits agree on at least two whole blocks, so every link is seen in
some shard. In each shard the fingerprints form a BK-tree whose children are
keyed by their Hamming distance to the parent, and a query follows only the
edges within the radius. A shard with very many fingerprints is split: each part
gets the whole shard tree and a share of its queries. A shard reports links of a
spanning forest, not all pairs; connected components join the shards.

A broadcast of all trees to all tasks would grow with the corpus, so a tree is
sent only to the tasks that query its shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import distinct_name, map_batches
from seqloom.operators.graph import connected_components
from seqloom.runtime import Scratch, attach, ship_package

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Bit blocks (start, width); any two of the five select a shard.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A shard with more fingerprints than this is queried by several tasks.
SHARD_QUERIES = 4096
#: Fingerprints whose trees are built at once, and (query, node) pairs visited at once: these bound a task's memory.
FOREST_ROWS, FRONTIER = 200_000, 2_000_000


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of word shingles, repeats included, as an unsigned 64-bit number.

    A-Z become lower case; words are what ASCII white space separates. Fewer
    words than a shingle has make one shingle; no words give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)), repeat(seed))
    for start in range(0, n, 1 << 16):  # a very long text in bounded steps
        own = np.fromiter(hashes, dtype="<u8", count=min(1 << 16, n - start))
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(own: np.ndarray) -> int:
    """The fingerprint of shingle hashes that are there already: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(own), 1 << 16):
        part = np.ascontiguousarray(own[start : start + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp as the signed number with the fingerprint's bits."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return map_batches(rows, "doc_id bigint, text_hash bigint, fp bigint", make)


def shard_keys(fp, blocks=BLOCKS):
    """One number for each pair of blocks: which pair, and the bits of both."""
    part = lambda k: F.shiftrightunsigned(fp, blocks[k][0]).bitwiseAND(F.lit((1 << blocks[k][1]) - 1))
    pairs = combinations(range(len(blocks)), 2)
    return F.array(*(F.lit(i << 32) + F.shiftleft(part(a), 13) + part(b) for i, (a, b) in enumerate(pairs)))


class BKForest:
    """BK-trees of many shards in flat arrays, built level by level.

    shard: each value's shard, equal ones adjacent. A node is known by its row;
    the first row of a shard is its root. Children of a node are keyed by their
    Hamming distance to it, and no two children of a node have the same key.
    """

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        rows = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[rows]
        links = []
        while len(rows):
            slot = at * 65 + np.bitwise_count(value[rows] ^ value[at]).astype(np.int64)
            keys, where, back = np.unique(slot, return_index=True, return_inverse=True)
            links.append((keys, rows[where]))  # rows ascend, so the first to reach a slot becomes the child there
            stays = np.ones(len(rows), bool)
            stays[where] = False
            at, rows = rows[where][back[stays]], rows[stays]
        keys = np.concatenate([k for k, _ in links]) if links else np.zeros(0, np.int64)
        child = np.concatenate([c for _, c in links]) if links else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.child = keys[order], child[order]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, node row) of the same shard at most radius apart, in blocks of bounded size."""
        at = self.root[queries]
        stack = [(queries, at)]
        while stack:
            q, at = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(q[:half], at[:half]), (q[half:], at[half:])]
                continue
            d = np.bitwise_count(self.value[q] ^ self.value[at]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], at[near]
            low = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), "right")
            many = high - low
            total = int(many.sum())
            if total:
                ends = np.cumsum(many)
                rows = np.arange(total) - np.repeat(ends - many, many) + np.repeat(low, many)
                stack.append((np.repeat(q, many), self.child[rows]))


class Groups:
    """Disjoint sets over rows, joined by arrays of pairs; the smallest row stands for its set."""

    def __init__(self, n: int):
        self.least = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.least[a], self.least[b]
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(a):
                return
            np.minimum.at(self.least, b, a)
            while True:
                up = self.least[self.least]
                if (up == self.least).all():
                    break
                self.least = up


def forest_links(shard: np.ndarray, value: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, value) that connect what lies within radius in each shard, fewer than there are rows."""
    forest, groups = BKForest(shard, value), Groups(len(value))
    queries = np.flatnonzero(asks)
    for start in range(0, len(queries), FOREST_ROWS):
        for q, at in forest.within(queries[start : start + FOREST_ROWS], radius):
            groups.join(q, at)
    linked = np.flatnonzero(groups.least != np.arange(len(value)))
    return value[linked], value[groups.least[linked]]


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that connect all that differ in at most radius bits."""
    if radius > 3:
        raise ValueError("five blocks find every pair of up to 3 differing bits, not more")
    ship_package(distinct.sparkSession)
    keys = scratch.keep(distinct.select("fp", F.explode(shard_keys(F.col("fp"))).alias("shard")), "shards")
    shared = keys.groupBy("shard").agg(F.count("*").alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / SHARD_QUERIES).cast("bigint")
    rows = (
        keys.join(shared, "shard")
        .withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select("shard", "part", "fp", (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")).alias("asks"))
    )
    # A number of its own for the exchange: AQE may then neither skip nor merge partitions by shard alone.
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            column = lambda c: whole.column(c).to_numpy()
            shard, part, value, asks = column("shard"), column("part"), column("fp").view(np.uint64), column("asks")
            same = np.r_[True, (shard[1:] == shard[:-1]) & (part[1:] == part[:-1])]
            group = np.cumsum(~same)
            end = len(group) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            held[:] = [] if last else [b for b in whole.slice(end).combine_chunks().to_batches() if b.num_rows]
            if end:
                u, v = forest_links(group[:end], value[:end], asks[:end], radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= FOREST_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_hash, fp, component_id.

    Fingerprints at most radius bits apart are linked; component_id is the
    smallest doc_id reachable over links, the document's own included. Null and
    empty texts have fingerprint zero, linked like any other. Repeated rows are
    kept and share a component. Null doc_ids are never a component's id unless
    all its documents lack one. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("size")), "distinct")
    found = scratch.keep(links(distinct, scratch, radius), "links")
    joined = scratch.keep(connected_components(docs.sparkSession, found, scratch), "components")
    linked = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = scratch.keep(linked, "linked")
    ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    groups = scratch.keep(linked.join(ids, "component").select("fp", "component_id", "size"), "groups")
    total = distinct.agg(F.sum("size")).first()[0] or 0
    return attach(prints, groups, "fp", "size", total).select("doc_id", "text_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without those whose component has a smaller doc_id; all columns kept, as are rows without doc_id."""
    scratch = Scratch(docs.sparkSession, "simhash-filter")
    key_id, key_hash = distinct_name(docs, "gone_id"), distinct_name(docs, "gone_hash")
    gone = near_duplicates(docs, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash)).distinct()
    gone = scratch.keep(gone, "gone")
    return docs.join(gone, (docs["doc_id"] == gone[key_id]) & (F.xxhash64(docs["text"].cast("string")) == gone[key_hash]), "left_anti")
