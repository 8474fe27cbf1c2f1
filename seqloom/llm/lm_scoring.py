"""N-gram language-model scores from an Elias-Fano trie in shards.

The model is a trigram model by interpolated absolute discounting over whole words;
below the bigrams stand add-half unigram probabilities. Every training word is a
context and a successor of its own, whatever the size of the corpus.

Texts are read and cut once. A block of texts names its distinct words by 64-bit
hashes; shards of the first level count them over all blocks and number them, the
frequent ones low. The block then asks the trie for its distinct bigrams and
trigrams, with how often each occurs in training texts. A shard of the trie holds
some first words with all bigrams and trigrams that begin with them: it adds up what
all blocks say, builds its levels (elias_fano.TrieShard) and answers every block
with quantised probabilities and backoff weights, from which the block sums up its
texts' scores.

Shards are meant for SHARD_USES n-gram uses, so their number follows the corpus. A
word with over SPLIT uses has its bigrams dealt to several shards by the second
word; a bigram with over SPLIT uses has its trigrams dealt by the third. Such shards
hold counts instead of probabilities, since only all of a context's shards together
know its total; the totals, at most 2 * tokens / SPLIT rows, go to the tasks that sum
up. A block sends a shard one row at most, so rows are never more than n-grams.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches
from seqloom.llm.elias_fano import EliasFano, TrieShard
from seqloom.runtime import Scratch, free_shuffles, ship_package

DISCOUNT = 0.75
#: Logarithms are kept in steps of 1/QUANTUM of a decimal place, in 16 bits.
QUANTUM = 4096
#: N-gram uses that a shard is meant for, uses from which a context is split, and tokens that a task holds before it sends a block.
SHARD_USES, SPLIT, FLUSH_TOKENS = 1_000_000, 250_000, 600_000
END = b""
#: Bits of a word's number, and of a context's place within a shard.
WORD_BITS = 40


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z lowered, cut at ASCII white space, and the end."""
    own = (text or "").encode().lower().split()
    own.append(END)
    return own


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<IB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueeze(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.reshape(-1).view("<u8")


def rising(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers by their differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unrising(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data), dtype=np.uint64)


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    ends = 4 + 4 * n + np.cumsum((0, *struct.unpack_from(f"<{n}I", data, 4)))
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows starts, and where the last one ends."""
    if not len(columns[0]):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1, len(columns[0])]


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers spread over 32 bits."""
    z = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- blocks of texts, and the first level

_WORDS = "block bigint, shard int, a binary, b binary"


def cut_blocks(docs: DataFrame, bits: int, most: int) -> DataFrame:
    """(block, shard, a, b): of each block its texts (shard -1: a) and for each of 2^bits shards its words: a: hashes, b: training counts.

    A block is cut once it holds about `most` tokens. Within it a word is known by its
    place among the block's sorted hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            own = [tokens(t) for _, _, _, t in held]
            sizes = np.array([len(t) for t in own])
            flat = [t for ts in own for t in ts]
            names = list(dict.fromkeys(flat))
            hashes = hashed(names)
            order = np.argsort(hashes, kind="stable")
            place = dict(zip([names[k] for k in order], range(len(names))))
            at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
            hashes = hashes[order]
            out_of = np.array([h for _, _, h, _ in held])
            counts = np.bincount(at[~np.repeat(out_of, sizes)], minlength=len(names))
            ids = np.array([d if d is not None else 0 for _, d, _, _ in held], np.int64)
            none = np.array([d is None for _, d, _, _ in held], np.uint8)
            content = bundle(ids.tobytes(), none.tobytes(), out_of.astype(np.uint8).tobytes(), squeeze(sizes), squeeze(at))
            rows = [(-1, content, None)]
            shards = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cuts = runs_of(shards)
            rows += [(int(shards[a]), rising(hashes[a:b]), squeeze(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
            s, a, b = zip(*rows, strict=True)
            block = held[0][0]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(s, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["block", "shard", "a", "b"])

        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "held", "text")), strict=True):
                held.append(item)
                n += len(item[3] or "") // 5 + 1
                if n >= most:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _WORDS)


#: Kinds of rows that the shards of the first level give: an answer to a block, the level itself, and what the driver needs.
ANSWER, LEVEL, TOTALS = 0, 1, 2
_COUNTED = "kind int, block bigint, shard int, a binary, b binary"


def count_words(bits: int, split: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adds up a shard's words over all blocks and numbers those seen in training: from 1, by rank within the shard, so frequent ones are low."""

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        hashes = [unrising(a) for a in rows.column("a").to_pylist()]
        counts = np.concatenate([unsqueeze(b) for b in rows.column("b").to_pylist()]).astype(np.int64)
        own, back = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(back, counts, len(own)).astype(np.int64)
        order = np.lexsort((own, -n))[: int((n > 0).sum())]
        numbers = np.zeros(len(own), np.int64)
        numbers[order] = 1 + (np.arange(len(order)) << bits) + shard
        out, start = [], 0
        for block, h in zip(rows.column("block").to_pylist(), hashes, strict=True):
            at = back[start : start + len(h)]
            start += len(h)
            out.append((ANSWER, block, squeeze(numbers[at]), squeeze(n[at])))
        seen = n > 0
        out.append((LEVEL, None, EliasFano.build(own[seen]), bundle(squeeze(numbers[seen]), squeeze(n[seen]))))
        hot = n > split
        out.append((TOTALS, None, np.array([n.sum(), seen.sum()], np.int64).tobytes(), np.r_[numbers[hot], n[hot]].astype(np.int64).tobytes()))
        kind, block, a, b = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "shard": pa.array([shard] * len(out), pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return count


# ---------------------------------------------------------------- blocks in numbers, and what they ask

_none = lambda: np.zeros(0, np.int64)


@dataclass
class Plan:
    """How contexts are dealt to shards: shards from `shards` on belong to split contexts, which are few (see above)."""

    total: int
    distinct: int
    shards: int
    split: int = SPLIT
    #: Numbers of split words, ascending, the first shard of each, and how many it has.
    words: np.ndarray = field(default_factory=_none)
    first: np.ndarray = field(default_factory=_none)
    parts: np.ndarray = field(default_factory=_none)
    #: Split bigrams, ascending by first and second word; their shards.
    pair1: np.ndarray = field(default_factory=_none)
    pair2: np.ndarray = field(default_factory=_none)
    pair_first: np.ndarray = field(default_factory=_none)
    pair_parts: np.ndarray = field(default_factory=_none)

    @property
    def mass(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def split_word(self, numbers: np.ndarray) -> np.ndarray:
        """Which split word each number is, -1 for none."""
        return _place(self.words, numbers)

    def shard(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        own = self.split_word(x)
        k = np.maximum(own, 0)
        return np.where(own >= 0, self.first[k] + mixed(y) % self.parts[k], mixed(x) % self.shards) if len(self.words) else mixed(x) % self.shards

    def split_pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which split bigram each pair of numbers is, -1 for none."""
        out = np.full(len(x), -1)
        for k, (a, b) in enumerate(zip(self.pair1.tolist(), self.pair2.tolist(), strict=True)) if len(self.pair1) <= 64 else ():
            out[(x == a) & (y == b)] = k
        if len(self.pair1) > 64:
            at = {p: k for k, p in enumerate(zip(self.pair1.tolist(), self.pair2.tolist(), strict=True))}
            may = np.flatnonzero(np.isin(x, self.pair1) & np.isin(y, self.pair2))
            out[may] = [at.get(p, -1) for p in zip(x[may].tolist(), y[may].tolist(), strict=True)]
        return out


def _place(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return np.where(ascending[at] == wanted, at, -1)


class Block:
    """A block's texts in the block's own numbers (0: not seen in training), and what they ask of the trie."""

    def __init__(self, data: bytes):
        ids, none, held, sizes, at, numbers, counts = unbundle(data)
        self.ids, self.none, self.held = np.frombuffer(ids, np.int64), np.frombuffer(none, bool), np.frombuffer(held, bool)
        self.sizes = unsqueeze(sizes).astype(np.int64)
        self.at = unsqueeze(at).astype(np.int64)
        self.numbers = np.r_[np.int64(0), unrising(numbers).astype(np.int64)]
        self.counts = np.r_[np.int64(0), unsqueeze(counts).astype(np.int64)]
        ends = np.cumsum(self.sizes)
        self.first = np.r_[0, ends[:-1]]
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.before = np.arange(len(self.at)) - 1  # place of the token before; before a text stands its own end
        self.before[self.first] = ends - 1

    @staticmethod
    def number(content: bytes, numbers: np.ndarray, counts: np.ndarray) -> bytes:
        """A cut block with its words' numbers and counts, both by place."""
        ids, none, held, sizes, at = unbundle(content)
        known = np.flatnonzero(numbers)
        known = known[np.argsort(numbers[known])]
        rank = np.zeros(len(numbers), np.int64)
        rank[known] = 1 + np.arange(len(known))
        return bundle(ids, none, held, sizes, squeeze(rank[unsqueeze(at).astype(np.int64)]), rising(numbers[known].astype(np.uint64)), squeeze(counts[known]))

    def _distinct(self, where: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, which one each place has, and how often each occurs in training texts."""
        own, back = np.unique(key, return_inverse=True)
        return own, back, np.bincount(back[~self.held[self.text[where]]], minlength=len(own))

    def heavy(self, plan: Plan) -> np.ndarray:
        """Bigrams so frequent here that they may have over SPLIT uses in all: one with more must be as frequent in some block."""
        where = np.flatnonzero((self.at[self.before] > 0) & (self.at > 0))
        own, _, n = self._distinct(where, self.at[self.before[where]] * len(self.numbers) + self.at[where])
        most = n > max(1, plan.split / 2 * (~self.held[self.text]).sum() / max(1, plan.total))
        x, y = np.divmod(own[most], len(self.numbers))
        return np.stack([self.numbers[x], self.numbers[y], n[most]]) if most.any() else np.zeros((3, 0), np.int64)

    def ask(self, plan: Plan) -> None:
        """Distinct pairs by shard, context and successor, and distinct triples by pair; which of them each token has."""
        n, at = len(self.numbers), self.at
        where = np.flatnonzero(at[self.before] > 0)
        own, back, count = self._distinct(where, at[self.before[where]] * n + at[where])
        x, y = np.divmod(own, n)
        x, y = self.numbers[x], self.numbers[y]
        split = plan.split_pair(x, y) if len(plan.pair1) else np.full(len(own), -1)
        shard = plan.shard(x, y)
        # A token with a pair before it continues that pair, unless it is the first of its text.
        pair = np.full(len(at), -1)
        pair[where] = back
        third = np.full(len(at), True)
        third[self.first] = False
        third = np.flatnonzero(third)
        third = third[(pair[third - 1] >= 0) & (at[third - 1] > 0) & (at[third] > 0)]
        of = pair[third - 1]
        apart = split[of] >= 0
        loose = third[apart]
        s_own, s_back, s_count = self._distinct(loose, split[of[apart]] * n + at[loose])
        sx, sy = np.divmod(s_own, n)
        sy = self.numbers[sy]
        s_shard = plan.pair_first[sx] + mixed(sy) % plan.pair_parts[sx] if len(sx) else sx
        shard, x, y, count = np.r_[shard, s_shard], np.r_[x, sx], np.r_[y, sy], np.r_[count, s_count]
        order = np.lexsort((y, x, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.shard, self.x, self.y, self.n = shard[order], x[order], y[order], count[order]
        self.pair = pair
        self.pair[where] = place[back]
        self.split_pair = np.r_[split, np.full(len(sx), -1)][order]
        self.loose, self.loose_at = loose, place[len(own) + s_back] if len(loose) else loose
        self.tied = third[~apart]
        t_own, self.tied_at, self.t_n = self._distinct(self.tied, place[of[~apart]] * n + at[self.tied])
        self.t_pair, t_y = np.divmod(t_own, n)
        self.t_y = self.numbers[t_y]

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """For each shard: contexts, pairs of each, successors, counts; triples of each pair, successors, counts."""
        cuts = runs_of(self.shard)
        triples = np.searchsorted(self.t_pair, cuts)
        many = np.bincount(self.t_pair, minlength=len(self.x))
        for a, b, c, d in zip(cuts, cuts[1:], triples, triples[1:]):
            runs = runs_of(self.x[a:b])
            yield int(self.shard[a]), bundle(
                rising(self.x[a:b][runs[:-1]].astype(np.uint64)), squeeze(np.diff(runs)), squeeze(self.y[a:b]), squeeze(self.n[a:b]), squeeze(many[a:b]), squeeze(self.t_y[c:d]), squeeze(self.t_n[c:d])
            )


# ---------------------------------------------------------------- the shards of the trie

_SHARD = "kind int, block bigint, shard int, a binary"


def log_code(p: np.ndarray) -> np.ndarray:
    """-log10 in 1/QUANTUM, from 1 on; 0 stands for what is missing."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log10(p) * QUANTUM), 0, 65534) + 1, 0).astype(np.int64)


def from_code(code: np.ndarray, missing: float) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((1 - code.astype(np.float64)) / QUANTUM), missing)


def shares(n: np.ndarray, of: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of discounted probabilities of successors seen n times after context `of`, and of the contexts' backoff weights."""
    total, kinds = np.bincount(of, n, contexts), np.bincount(of, n > 0, contexts)
    with np.errstate(divide="ignore", invalid="ignore"):
        return log_code(np.where(n > 0, (n - DISCOUNT) / total[of], 0)), log_code(np.where(total > 0, DISCOUNT * kinds / total, 0))


def answer_shard(shards: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Adds up one shard's n-grams over all blocks, builds its trie and answers each block from it."""

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        split = shard >= shards
        asked = [[unsqueeze(p).astype(np.int64) if k else unrising(p).astype(np.int64) for k, p in enumerate(unbundle(a))] for a in rows.column("a").to_pylist()]
        column = lambda k: np.concatenate([q[k] for q in asked])
        x, of_x = np.unique(column(0), return_inverse=True)
        if len(x) >> (63 - WORD_BITS) or max((int(q[k].max()) for q in asked for k in (2, 5) if len(q[k])), default=0) >> WORD_BITS:
            raise OverflowError("a shard's contexts or the vocabulary are beyond the number of bits; lower SHARD_USES or raise WORD_BITS")
        pairs, of_pair = np.unique((np.repeat(of_x, column(1)) << WORD_BITS) | column(2), return_inverse=True)
        n = np.bincount(of_pair, column(3), len(pairs)).astype(np.int64)
        if len(pairs) >> (63 - WORD_BITS):
            raise OverflowError("a shard has too many pairs; lower SHARD_USES")
        triples, of_triple = np.unique((np.repeat(of_pair, column(4)) << WORD_BITS) | column(5), return_inverse=True)
        t_n = np.bincount(of_triple, column(6), len(triples)).astype(np.int64)
        low = (1 << WORD_BITS) - 1
        context, y, of, z = pairs >> WORD_BITS, pairs & low, triples >> WORD_BITS, triples & low
        # What training texts hold becomes the trie.
        p, t = np.flatnonzero(n), np.flatnonzero(t_n)
        has = np.zeros(len(x), bool)
        has[context[p]] = True
        at_context, at_pair = np.cumsum(has) - 1, np.cumsum(n > 0) - 1
        c2, c3 = at_context[context[p]], at_pair[of[t]]
        second, own = shares(n[p], c2, int(has.sum()))
        third, second_own = shares(t_n[t], c3, len(p))
        out = []
        if split:
            total, kinds = np.bincount(c2, n[p], int(has.sum())), np.bincount(c2, minlength=int(has.sum()))
            out.append((TOTALS, None, np.stack([x[has], total.astype(np.int64), kinds]).astype(np.int64).tobytes()))
            second, own = n[p], np.zeros(int(has.sum()), np.int64)
        starts2, starts3 = np.r_[0, np.cumsum(np.bincount(c2, minlength=int(has.sum())))], np.r_[0, np.cumsum(np.bincount(c3, minlength=len(p)))]
        content = TrieShard.build(x[has], starts2, y[p], starts3, z[t], own, second, second_own, third)
        trie = TrieShard(content)
        place, own, second, second_own = trie.pairs(x[context].astype(np.uint64), y)
        third = trie.triples(place[of], z)
        a = c = 0
        for block, q in zip(rows.column("block").to_pylist(), asked, strict=True):
            e, f = of_pair[a : a + len(q[2])], of_triple[c : c + len(q[5])]
            a, c = a + len(q[2]), c + len(q[5])
            out.append((ANSWER, block, bundle(squeeze(second[e]), squeeze(own[e[np.r_[0, np.cumsum(q[1])[:-1]]]]), squeeze(second_own[e]), squeeze(third[f]))))
        out.append((LEVEL, None, content))
        kind, block, content = zip(*out, strict=True)
        return pa.table({"kind": pa.array(kind, pa.int32()), "block": pa.array(block, pa.int64()), "shard": pa.array([shard] * len(out), pa.int32()), "a": pa.array(content, pa.binary())})

    return answer


@dataclass
class Totals:
    """How often each split context is one, and how many successors it has; words by number, bigrams by place in the plan."""

    word_n: np.ndarray
    word_kinds: np.ndarray
    pair_n: np.ndarray
    pair_kinds: np.ndarray


def sum_up(block: Block, plan: Plan, totals: Totals, answers: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and score of each text. answers: by shard, as asked."""
    texts, at = len(block.sizes), block.at
    second, own, second_own, third = (np.concatenate([_none(), *(a[k] for a in answers)]).astype(np.int64) for k in range(4))
    of_run = np.cumsum(np.r_[True, (np.diff(block.shard) != 0) | (np.diff(block.x) != 0)]) - 1 if len(block.x) else _none()
    share = from_code(second, 0.0)
    backoff = from_code(own[of_run], 1.0)
    whole = block.shard >= plan.shards  # pairs of split contexts: counts instead of codes
    k = np.flatnonzero(whole)
    if len(k):
        word = plan.split_word(block.x[k])
        by_word = block.shard[k] < (plan.pair_first[0] if len(plan.pair_first) else 1 << 62)
        word, pair = np.where(by_word, word, 0), np.where(by_word, 0, block.x[k])
        pick = lambda w, p: np.where(by_word, w[word] if len(w) else 0, p[pair] if len(p) else 0)
        n, kinds = pick(totals.word_n, totals.pair_n), pick(totals.word_kinds, totals.pair_kinds)
        share[k] = np.maximum(second[k] - DISCOUNT, 0) / np.maximum(n, 1)
        backoff[k] = np.where(n > 0, DISCOUNT * kinds / np.maximum(n, 1), 1.0)
    one = (block.counts[at] + 0.5) / plan.mass
    two = one.copy()
    asked = np.flatnonzero(block.pair >= 0)
    e = block.pair[asked]
    two[asked] = share[e] + backoff[e] * one[asked]
    after = from_code(second_own, 1.0)  # backoff weight of a pair as a context
    k = np.flatnonzero(block.split_pair >= 0)
    if len(k):
        s = block.split_pair[k]
        after[k] = np.where(totals.pair_n[s] > 0, DISCOUNT * totals.pair_kinds[s] / np.maximum(totals.pair_n[s], 1), 1.0)
    inner = np.full(len(at), True)
    inner[block.first] = False
    inner = np.flatnonzero(inner)
    inner = inner[block.pair[inner - 1] >= 0]
    three = two.copy()
    three[inner] = after[block.pair[inner - 1]] * two[inner]
    three[block.tied] += from_code(third, 0.0)[block.tied_at]
    three[block.loose] += share[block.loose_at]
    by_text = lambda v: np.bincount(block.text, v, texts)
    return block.sizes, by_text(at > 0).astype(np.int64), by_text(np.log10(one)), by_text(np.log10(three))


# ---------------------------------------------------------------- the whole


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


@dataclass
class Model:
    """scores: doc_id, held_out, n_tokens, n_known, base_score, score. words and trie: the levels, a row for each shard."""

    scores: DataFrame
    train_tokens: int
    words: DataFrame  # shard, a: hashes in Elias-Fano form, b: numbers and counts
    trie: DataFrame  # shard, a: a TrieShard


def fit_and_score(docs: DataFrame) -> Model:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)) + F.count("*")).first()[0]
    uses = size // 5 + 1  # about so many tokens, for the number of shards only
    bits, shards = max(0, (uses // (4 * SHARD_USES)).bit_length()), max(1, -(-uses // SHARD_USES))

    cut = scratch.keep(cut_blocks(docs, bits, FLUSH_TOKENS), "cut")
    counted = scratch.keep(cut.filter("shard >= 0").groupBy("shard").applyInArrow(count_words(bits, SPLIT), _COUNTED), "words")
    free_shuffles(spark)
    facts = counted.filter(f"kind = {TOTALS}").select("a", "b").collect()  # a row for each shard
    sums = np.sum([np.frombuffer(bytes(r.a), np.int64) for r in facts], axis=0) if facts else np.zeros(2, np.int64)
    hot = np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(bytes(r.b), np.int64).reshape(2, -1) for r in facts)], axis=1)
    hot = hot[:, np.argsort(hot[0])]
    plan = Plan(int(sums[0]), int(sums[1]), shards, SPLIT, hot[0])
    plan.parts = -(-hot[1] // plan.split)
    plan.first = shards + np.cumsum(np.r_[np.int64(0), plan.parts])[:-1]
    sent = spark.sparkContext.broadcast(plan)

    def number(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("shard").to_numpy())
        numbers, counts = (np.concatenate([unsqueeze(answers.column(c)[int(k)].as_py()) for k in order]).astype(np.int64) for c in ("a", "b"))
        content = Block.number(texts.column("a")[0].as_py(), numbers, counts)
        heavy = Block(content).heavy(sent.value)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "a": pa.array([content], pa.binary()), "b": pa.array([heavy.tobytes()], pa.binary())})

    numbered = cut.filter("shard < 0").select("block", "a").groupBy("block").cogroup(counted.filter(f"kind = {ANSWER}").select("block", "shard", "a", "b").groupBy("block")).applyInArrow(number, "block bigint, a binary, b binary")
    blocks = scratch.keep(numbered, "blocks")
    words = scratch.keep(counted.filter(f"kind = {LEVEL}").select("shard", "a", "b"), "level")
    scratch.drop(cut, counted)
    free_shuffles(spark)
    plan = with_pairs(plan, blocks)
    sent = spark.sparkContext.broadcast(plan)

    def ask() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for name, data in zip(batch.column("block").to_pylist(), batch.column("a"), strict=True):
                block = Block(data.as_py())
                block.ask(sent.value)
                out += [(name, *q) for q in block.questions()]
            block, shard, a = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(a, pa.binary())], names=["block", "shard", "a"])

        return each

    asked = map_batches(blocks.select("block", "a"), "block bigint, shard int, a binary", ask)
    tries = scratch.keep(asked.groupBy("shard").applyInArrow(answer_shard(shards), _SHARD), "trie", compression="zstd")
    free_shuffles(spark)
    totals = split_totals(plan, tries)
    said = spark.sparkContext.broadcast(totals)

    def score(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts.column("a")[0].as_py())
        block.ask(sent.value)
        order = np.argsort(answers.column("shard").to_numpy()) if answers.num_rows else []
        got = [[unsqueeze(p) for p in unbundle(answers.column("a")[int(k)].as_py())] for k in order]
        n, known, base, scores = sum_up(block, sent.value, said.value, got)
        return pa.table({"doc_id": pa.array(block.ids, mask=block.none), "held_out": pa.array(block.held), "n_tokens": n, "n_known": known, "base_score": base, "score": scores})

    answers = tries.filter(f"kind = {ANSWER}").select("block", "shard", "a")
    scores = blocks.select("block", "a").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return Model(scores, plan.total, words, tries.filter(f"kind = {LEVEL}").select("shard", "a"))


def with_pairs(plan: Plan, blocks: DataFrame) -> Plan:
    """The plan with split bigrams: what blocks report sums to at least half of SPLIT for each that has over SPLIT uses."""
    reports = blocks.filter(F.length("b") > 0)

    def each() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(b, np.int64).reshape(3, -1) for b in batch.column("b").to_pylist())], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["x", "y", "n"])

        return one

    pairs = map_batches(reports.select("b"), "x bigint, y bigint, n bigint", each).groupBy("x", "y").agg(F.sum("n").alias("n"))
    found = sorted((r.x, r.y, r.n) for r in pairs.filter(F.col("n") > plan.split // 2).collect())  # at most 2 * tokens / SPLIT rows
    if not found:
        return plan
    x, y, n = (np.array(c, np.int64) for c in zip(*found, strict=True))
    parts = -(-2 * n // plan.split)
    first = plan.shards + int(plan.parts.sum()) + np.cumsum(np.r_[np.int64(0), parts])[:-1]
    return Plan(plan.total, plan.distinct, plan.shards, plan.split, plan.words, plan.first, plan.parts, x, y, first, parts)


def split_totals(plan: Plan, tries: DataFrame) -> Totals:
    """Adds up what the shards of split contexts say; as many rows as there are such shards."""
    rows = tries.filter(f"kind = {TOTALS}").select("shard", "a").collect() if len(plan.words) or len(plan.pair1) else []
    sums = [np.zeros((2, len(plan.words)), np.int64), np.zeros((2, len(plan.pair1)), np.int64)]
    for r in rows:
        key, n, kinds = np.frombuffer(bytes(r.a), np.int64).reshape(3, -1)
        pair = len(plan.pair_first) and r.shard >= plan.pair_first[0]
        at = key if pair else plan.split_word(key)
        np.add.at(sums[int(bool(pair))], (slice(None), at), np.stack([n, kinds]))
    return Totals(*sums[0], *sums[1])


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all documents that held_out() leaves. base_score sums
    log10 of add-half unigram probabilities; score is the model's log10
    probability of the text, whose first word follows an end and whose other words
    follow two. Null and empty texts are one end token. Repeated rows are counted
    and scored each. Empty tables give no rows; without training documents both
    scores are those of a model that has seen nothing.
    """
    model = fit_and_score(docs)
    return model.scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
