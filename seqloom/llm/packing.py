"""Packing documents into fixed windows by best-fit decreasing.

A document's token ids are cut into full windows and a rest. Pieces are placed
longest first, each into the open window with the least room that still holds
it; a segment tree over remaining capacities finds that window in a logarithm of
the window length. Documents are tokenised where they are read; only piece
lengths and checksums are shuffled, in groups of bounded size.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches
from seqloom.runtime import Scratch

WINDOW, END_ID = 2048, 1
#: Pieces packed together: enough for nearly full windows, few enough for any task.
GROUP_PIECES = 16_384
#: Words whose ids a worker keeps between batches (about 30 MB), the longest word kept, and what stays when the memory is full: short words recur most.
CACHE_ENTRIES, CACHE_CHARS, CACHE_SHORT = 1_200_000, 40, 6
#: Bytes of text tokenised at once.
SLICE_BYTES = 4_000_000


class WordIds:
    """Token ids of texts for a vocabulary whose tokens never cross white space, remembered by word."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Known words, their ids one after another, and where each word's begin and how many there are."""
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, words: pa.Array, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(words), CACHE_CHARS).to_numpy(zero_copy_only=False)
        if len(self.words) + int(short.sum()) > CACHE_ENTRIES:
            stays = pc.less_equal(pc.utf8_length(self.words), CACHE_SHORT).to_numpy(zero_copy_only=False)
            old = (self.words.filter(pa.array(stays)), self.flat, self.first[stays], self.sizes[stays])
            self.forget()
            if len(old[0]) < CACHE_ENTRIES // 2:
                self._add(*old)
        if int(short.sum()) <= CACHE_ENTRIES:
            self._add(words.filter(pa.array(short)), flat, first[short], sizes[short])

    def _add(self, words: pa.Array, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        own = flat[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
        self.words, self.flat, self.sizes = pa.concat_arrays([self.words, words]), np.concatenate([self.flat, own]), np.concatenate([self.sizes, sizes])

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, sizes = array("I"), np.zeros(len(words), np.int64)
        for k in range(0, len(words), 4096):
            for j, e in enumerate(self.tokenizer.encode_batch_fast(words.slice(k, 4096).to_pylist(), add_special_tokens=False), k):
                own = e.ids
                sizes[j] = len(own)
                flat.extend(own)
        return np.frombuffer(flat.tobytes(), "<u4"), np.cumsum(sizes) - sizes, sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (one more: where the last one's end).

        Cutting at ASCII white space is enough: longer chunks are encoded as they are.
        """
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        known = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(known).to_numpy(zero_copy_only=False)
        at = pc.fill_null(known, 0).to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(missing))
        flat, new_first, new_sizes = self._encode(new)
        first, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[~missing], sizes[~missing] = self.first[at[~missing]], self.sizes[at[~missing]]
        first[missing], sizes[missing] = len(self.flat) + new_first, new_sizes
        every = np.concatenate([self.flat, flat])
        if len(new):
            self._keep(new, flat, new_first, new_sizes)
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        spot = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[which] - ends + n, n)
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        return every[spot], np.r_[0, ends][offsets]

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """ids() of slices of the texts of bounded size, each with its first row."""
        sizes, start, held = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0, 0
        for k, n in enumerate(sizes.tolist()):
            if held and held + n > SLICE_BYTES:
                yield start, *self.ids(texts.slice(start, k - start))
                start, held = k, 0
            held += n
        if len(texts) > start:
            yield start, *self.ids(texts.slice(start))


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


class CapacityTree:
    """Open windows by remaining capacity, in a segment tree that counts the windows below each node."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, window_id: int, capacity: int) -> None:
        self.open[capacity].append(window_id)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (window, its capacity) with the least capacity of at least need; None if there is none."""
        count, node = self.count, self.leaves + need
        while not count[node]:
            while node & 1:  # no leaf to the right below this parent
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each piece. lengths descend; each is between 1 and window."""
    tree, placed, opened = CapacityTree(window), [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            found, opened = (opened, window), opened + 1
        k, room = found
        placed.append((k, window - room))
        if room > n:
            tree.add(k, room - n)
    return placed


def pieces(docs: DataFrame, path: Callable[[], str], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut into full windows and a rest."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    end = np.array([end_id], "<u4")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encode = word_ids(path()).slices

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            names = batch.column("doc_id").to_pylist()
            for first, ids, starts in encode(batch.column("text")):
                for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), first):
                    own, total = np.concatenate([ids[a:b], end]), b - a + 1
                    for start in range(0, total, window):
                        piece = own[start : start + window]
                        for column, value in zip(out, (names[k], start, len(piece), zlib.crc32(piece), total), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), schema, make)


def pack(docs: DataFrame, path: Callable[[], str], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most window ids; pieces of a sequence follow each other
    without gaps from offset 0. Null and empty texts are one piece holding the
    end id alone. Repeated rows are packed each. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, path, window, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending")])
        placed = best_fit(rows.column("length").to_pylist(), window)
        first = key[0].as_py() << 32
        own = rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return own.append_column("sequence_id", pa.array([first + k for k, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint")).groupBy("group").applyInArrow(place, schema)


def sequences(packed: DataFrame, docs: DataFrame, path: Callable[[], str], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids array<int>: the packed windows themselves. doc_id must be unique in docs."""
    schema = "doc_id bigint, ids array<int>"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encode = word_ids(path()).slices

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [[*own[a:b].tolist(), end_id] for _, own, starts in encode(batch.column("text")) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

        return each

    ids = map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), schema, make)
    own = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start") + 1, F.col("length").cast("int")).alias("ids"))
    return own.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
