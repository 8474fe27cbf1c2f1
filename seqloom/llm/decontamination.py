"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Benchmark items are cut into windows of consecutive normalised words. Every word
of the benchmark gets a character of its own, so a window is a short string and
a document a string with one character per word; the automaton finds all windows
in one pass and its offsets are word offsets, which map back to the text. The
benchmark is broadcast in blocks of bounded size: more items make more passes
over the documents, never a larger automaton.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import LOWER_ASCII, distinct_name, map_batches
from seqloom.runtime import Scratch, ship_package

WINDOW = 13
#: Characters of benchmark text in one automaton: about 5 MB to send and 60 MB in a worker.
BLOCK_CHARS = 1_000_000
#: Per byte: A-Z lowered, digits, a-z and bytes above 0x7F kept, all else a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The windows of some items, and the automaton that finds them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.codes: dict[bytes, str] = {}
        self.items: list[list[str]] = []
        self.widest = 0
        self.automaton = ahocorasick.Automaton()
        for name, text in items:
            own = words(text)
            coded = "".join(self._code(w) for w in own)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                part = coded[k : k + window]
                if part in self.automaton:
                    self.items[self.automaton.get(part)[0]].append(name)
                else:
                    self.automaton.add_word(part, (len(self.items), len(part)))
                    self.items.append([name])
        self.empty = not self.items
        if not self.empty:
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        if word not in self.codes:
            n = len(self.codes) + 1
            self.codes[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates can't stand in strings
        return self.codes[word]

    def find(self, own: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """Which words lie in an occurrence of a window (None: no window occurs), and the items found."""
        if self.empty:
            return None, set()
        coded, hit, found = "".join([self.codes.get(w, "\x00") for w in own]), None, set()
        for end, (k, n) in self.automaton.iter(coded):
            hit = hit or bytearray(len(own))
            hit[end - n + 1 : end + 1] = b"\x01" * n
            found.update(self.items[k])
        return hit, found


def spans(text: str, hit: bytearray) -> str:
    """start:end of each run of hit words in the original text (code points, end exclusive), comma-joined."""
    out, before = [], -2
    for k, m in enumerate(_WORD.finditer(text.translate(LOWER_ASCII))):
        if hit[k]:
            if before == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            before = k
    return ",".join(f"{a}:{b}" for a, b in out)


#: What a pass over the documents adds to each row.
_FOUND = "n_words bigint, n_hit bigint, hit binary, items array<string>"


def _pass(docs: DataFrame, block: list[tuple[str, str | None]], window: int, names: list[str]) -> DataFrame:
    """docs with the added columns; what an earlier pass has found is joined to what this one finds."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(block)
    later = names[0] in docs.columns
    added = T._parse_datatype_string(_FOUND)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string())]
    own = [c for c in docs.columns if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in own), *(T.StructField(n, f.dataType) for n, f in zip(names, added, strict=True))])

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        windows = Windows(sent.value, window)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for k, text in enumerate(batch.column("text").to_pylist()):
                w = words(text)
                hit, items = windows.find(w)
                if later:
                    if (old := batch.column(names[2])[k].as_py()) is not None:
                        hit = bytearray(a | b for a, b in zip(old, hit, strict=True)) if hit else bytearray(old)
                    items |= set(batch.column(names[3])[k].as_py())
                for column, value in zip(out, (len(w), sum(hit) if hit else 0, bytes(hit) if hit else None, sorted(items)), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=[*own, *names])

        return each

    return map_batches(docs, schema, make)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's (item_id, text) in blocks of about BLOCK_CHARS; no block is collected before it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS) or 1
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted(((r.item, r.text) for r in rows.collect()), key=str)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """docs with three added columns, and their names: the number of words, of hit words, which are hit, the items found."""
    names = [distinct_name(docs, n) for n in ("_n_words", "_n_hit", "_hit", "_items")]
    scratch, found, last = Scratch(docs.sparkSession, "decontamination"), docs, None
    for block in blocks(benchmark):
        if last is not None:  # a pass of its own, so that no task holds two automata
            found = scratch.keep(_pass(found, last, window, names), "pass")
        last = block
    return _pass(found, last, window, names), names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    A word is hit if it lies in an occurrence of a benchmark window; an item
    shorter than a window is one window, an item or document without words has
    none. contaminated: some word is hit and one_in * n_hit >= n_words. spans are
    the hit passages in the original text. Null texts count as empty, a null
    item_id as "null"; repeated rows are judged each; empty tables give no rows.
    """
    found, names = scan(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window)
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans string"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, hits, items = (batch.column(n).to_pylist() for n in names)
            texts = batch.column("text")
            arrays = [
                batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
                pa.array([n > 0 and one_in * n >= w for n, w in zip(n_hit, n_words, strict=True)]),
                pa.array(items, pa.list_(pa.string())), pa.array([spans(texts[k].as_py(), h) if h else "" for k, h in enumerate(hits)], pa.string()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

        return each

    return map_batches(found, schema, make)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20) -> DataFrame:
    """docs without contaminated ones, all columns kept; judged where they are read, nothing is shuffled."""
    found, names = scan(docs, benchmark, window)
    n_words, n_hit = F.col(names[0]), F.col(names[1])
    return found.filter(~((n_hit > 0) & (one_in * n_hit >= n_words))).drop(*names)
