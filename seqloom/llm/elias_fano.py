"""Elias-Fano sequences and the trie shard built of them, all in one flat buffer that is used where it lies."""

from __future__ import annotations

import mmap
import struct

import numpy as np


def _low_bits(value: np.ndarray, bits: int) -> bytes:
    """The low bits of each value, side by side."""
    if not bits:
        return bytes(8)
    planes = ((value[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes() + bytes(8)


#: PLACES[8 * b + k]: place of the k-th one in byte b.
PLACES = np.array([place for b in range(256) for place in (*(i for i in range(8) if b >> i & 1), *[0] * (8 - b.bit_count()))], np.int64)
_U = {n: np.uint64(n) for n in (1, 2, 3, 4, 8, 0xFF, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080)}


class EliasFano:
    """Ascending numbers: low bits side by side, high parts in unary, and a count of ones before each word of 64 bits.

    Nothing is unpacked: a number is read by selecting its one among the high
    bits, and a value is searched among the numbers whose high part it shares,
    which lie between two zeros.
    """

    def __init__(self, buffer, at: int = 0):
        self.n, self.bits, words, low = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        self.high = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.before = np.frombuffer(buffer, "<u4", words, at)
        at += 4 * words
        self.zeros = np.arange(words, dtype=np.int64) * 64 - self.before
        self.low = np.ndarray((low - 7,), "<u8", buffer, at, (1,))  # eight bytes from every byte on
        self.end = at + low
        self.mask = np.uint64((1 << self.bits) - 1)

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (top >> bits) + n + 2  # a zero ends each high part, the last one too
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[high] = 1
        words = np.packbits(marks, bitorder="little").view("<u8")
        before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype("<u4")
        low = b"".join(_low_bits(values[k : k + 65536], bits)[:-8] for k in range(0, n, 65536)) + bytes(8) if bits else bytes(8)
        return struct.pack("<QQQQ", n, bits, len(words), len(low)) + words.tobytes() + before.tobytes() + low

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    @staticmethod
    def _inside(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one in each word: the byte from counts of ones in all bytes at once, the bit from a table."""
        k = k.astype(np.uint64)
        ones = word - ((word >> _U[1]) & _U[0x5555555555555555])
        ones = (ones & _U[0x3333333333333333]) + ((ones >> _U[2]) & _U[0x3333333333333333])
        ones += ones >> _U[4]
        ones &= _U[0x0F0F0F0F0F0F0F0F]
        ones *= _U[0x0101010101010101]  # byte j: ones in bytes 0 to j
        passed = ((k * _U[0x0101010101010101]) | _U[0x8080808080808080]) - ones
        shift = np.bitwise_count(passed & _U[0x8080808080808080]).astype(np.uint64) << _U[3]
        rest = k - (((ones << _U[8]) >> shift) & _U[0xFF])
        return shift.astype(np.int64) + PLACES[((word >> shift) & _U[0xFF]) * _U[8] + rest]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero among the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + self._inside(~self.high[word], k - self.zeros[word])

    def at(self, k: np.ndarray) -> np.ndarray:
        """The k-th numbers."""
        k = np.asarray(k, np.int64)
        word = np.searchsorted(self.before, k.astype(np.uint32), "right") - 1
        high = word * 64 + self._inside(self.high[word], k - self.before[word]) - k
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(k)

    def find(self, wanted: np.ndarray, lo: np.ndarray | int = 0, hi: np.ndarray | None = None) -> np.ndarray:
        """Place of each wanted number between the places lo and hi, -1 where it is missing."""
        if not self.n or not len(wanted):
            return np.full(len(wanted), -1)
        hi = np.full(len(wanted), self.n) if hi is None else hi
        part = wanted >> np.uint64(self.bits)
        inside = part < np.uint64(64 * len(self.high) - self.n)  # there are so many zeros
        part = np.where(inside, part, 0).astype(np.int64)
        start = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) + 1 - part, 0)
        end = self._zero(part) - part
        start, end = np.maximum(start, lo), np.minimum(end, hi)
        stop, low = end.copy(), wanted & self.mask
        going = np.flatnonzero(inside & (start < end))
        while len(going):  # the search among equal high parts, all at once
            mid = (start[going] + end[going]) // 2
            less = self._low(mid) < low[going]
            start[going] = np.where(less, mid + 1, start[going])
            end[going] = np.where(less, end[going], mid)
            going = going[start[going] < end[going]]
        there = np.flatnonzero(inside & (start < stop))
        out = np.full(len(wanted), -1)
        hit = there[self._low(start[there]) == low[there]]
        out[hit] = start[hit]
        return out


class Level:
    """Successors of contexts: a pointer to where each context's begin, and the successors, made ascending over all contexts.

    To a successor stands added what ends the context before it, so that the
    whole level is one ascending sequence. A successor is searched relative to
    its context's start, between the context's pointer and the next one.
    """

    def __init__(self, buffer, at: int = 0):
        self.pointers = EliasFano(buffer, at)
        self.values = EliasFano(buffer, self.pointers.end)
        self.end = self.values.end

    @staticmethod
    def build(starts: np.ndarray, successors: np.ndarray) -> bytes:
        """starts: where each context's successors begin, and where the last ones end."""
        filled = np.flatnonzero(np.diff(starts))
        ends = successors[starts[filled + 1] - 1].astype(np.uint64) + np.uint64(1)
        base = np.r_[np.uint64(0), np.cumsum(ends, dtype=np.uint64)[:-1]] if len(filled) else np.zeros(0, np.uint64)
        return EliasFano.build(starts) + EliasFano.build(np.repeat(base, np.diff(starts)[filled]) + successors.astype(np.uint64))

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Place of each successor of each context, -1 where there is none."""
        if not len(context):
            return np.zeros(0, np.int64)
        run = np.r_[0, np.flatnonzero(np.diff(context)) + 1]  # equal contexts beside each other are looked up once
        each = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(context)]))
        lo, hi = self.pointers.at(context[run]).astype(np.int64), self.pointers.at(context[run] + 1).astype(np.int64)
        base = np.zeros(len(run), np.uint64)
        later = np.flatnonzero((lo > 0) & (lo < hi))
        base[later] = self.values.at(lo[later] - 1) + np.uint64(1)
        return self.values.find(base[each] + successor.astype(np.uint64), lo[each], hi[each])


class TrieShard:
    """Contexts, their successors, and the successors of those pairs, with quantised numbers beside each.

    own: for each context its code; second and second_own: for each pair its code
    and its code as a context; third: for each triple its code.
    """

    def __init__(self, buffer):
        self.contexts = EliasFano(buffer, 0)
        self.level2 = Level(buffer, self.contexts.end)
        self.level3 = Level(buffer, self.level2.end)
        n, n2, n3, at = self.contexts.n, self.level2.values.n, self.level3.values.n, self.level3.end
        wide = struct.unpack_from("<B", buffer, at)[0]  # bytes of a pair's code
        at += 1
        self.own = np.frombuffer(buffer, "<u2", n, at)
        self.second = np.frombuffer(buffer, f"<u{wide}", n2, at + 2 * n)
        self.second_own = np.frombuffer(buffer, "<u2", n2, at + 2 * n + wide * n2)
        self.third = np.frombuffer(buffer, "<u2", n3, at + 2 * n + (2 + wide) * n2)

    @classmethod
    def map(cls, path: str) -> TrieShard:
        """A shard in a file, mapped into memory and not read."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    @staticmethod
    def build(contexts, starts2, successors2, starts3, successors3, own, second, second_own, third) -> bytes:
        levels = [EliasFano.build(contexts), Level.build(starts2, successors2), Level.build(starts3, successors3)]
        wide = 2 if not len(second) or int(second.max()) < 1 << 16 else 8
        return b"".join([*levels, bytes([wide]), own.astype("<u2").tobytes(), second.astype(f"<u{wide}").tobytes(), second_own.astype("<u2").tobytes(), third.astype("<u2").tobytes()])

    @staticmethod
    def _codes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(len(at), codes.dtype)
        return np.where(at >= 0, codes[np.maximum(at, 0)], 0)

    #: Lookups done at once: a bound of memory.
    STEP = 1 << 18

    def pairs(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs, and the codes of the contexts, of the pairs and of the pairs as contexts; 0 where missing."""
        c, at = np.full(len(context), -1), np.full(len(context), -1)
        for k in range(0, len(c), self.STEP):
            part = slice(k, k + self.STEP)
            c[part] = self.contexts.find(context[part])
            known = k + np.flatnonzero(c[part] >= 0)
            at[known] = self.level2.find(c[known], successor[known])
        return at, self._codes(self.own, c), self._codes(self.second, at), self._codes(self.second_own, at)

    def triples(self, pair: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of the successors of pairs, given by their places; 0 where missing."""
        at = np.full(len(pair), -1)
        for k in range(0, len(at), self.STEP):
            known = k + np.flatnonzero(pair[k : k + self.STEP] >= 0)
            at[known] = self.level3.find(pair[known], successor[known])
        return self._codes(self.third, at)
