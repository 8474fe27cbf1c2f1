"""Token counts by the whole-token shortcut.

A vocabulary string that the tokenizer turns into one token when it stands alone
can be counted without running any merge. Which strings do is proved offline,
once for each process, by encoding the whole vocabulary. Texts are cut into
pre-tokens; those in the proved set count one, only the rest are merged.

No pre-token crosses from a word into the single space before the next one, so a
text whose spaces stand alone is counted by its words, each distinct word (with
its space) being cut and counted once for a batch and remembered. All other texts
are cut as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_batches

#: Fixed pattern of byte-level BPE pre-tokens, as the tokenizer's own file asks for ("use_regex").
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker keeps between batches (about 25 MB), the longest word kept, and what stays when the memory is full.
CACHE_ENTRIES, CACHE_CHARS, CACHE_SHORT = 1_000_000, 40, 6
#: Bytes of text counted at once.
SLICE_BYTES = 4_000_000
#: A space beside anything that may be white space: such texts are not cut into words. Wider than the tokenizer's own class, which is safe.
BESIDE = r"[\s\pZ\pC] | [\s\pZ\pC]"


class TokenCounter:
    """Counts tokens of texts as tokenizers would for a byte-level BPE file without normaliser."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(PRE_TOKEN).findall
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.whole = self.prove_whole()
        self.words, self.sizes = pa.array([], pa.string()), np.zeros(0, np.int64)

    def prove_whole(self) -> frozenset[str]:
        """Strings that are one pre-token and encode alone as exactly one token."""
        ids = sorted(set(self.tokenizer.get_vocab().values()))
        texts = [t for t in self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=True) if t and "�" not in t and t not in self.specials]
        alone = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return frozenset(t for t, e in zip(texts, alone, strict=True) if len(e.ids) == 1 and self.pieces(t) == [t])

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token, as is the library's default."""
        totals, pieces = [], []
        for text in texts:
            n, parts = 0, [text]
            if self.cut is not None and any(s in text for s in self.specials):
                parts = self.cut.split(text)
                n = len(parts) - 1
            totals.append(n)
            pieces.append([p for part in parts for p in self.pieces(part)])
        whole = self.whole
        rest = list(set().union(*pieces) - whole)
        found = {p: len(e.ids) for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)} if rest else {}
        return [n + sum(1 if p in whole else found[p] for p in own) for n, own in zip(totals, pieces, strict=True)]

    def _word_counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each distinct word behind a space."""
        known = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(known).to_numpy(zero_copy_only=False)
        at = pc.fill_null(known, 0).to_numpy(zero_copy_only=False)
        out = np.empty(len(words), np.int64)
        out[~missing] = self.sizes[at[~missing]]
        new = words.filter(pa.array(missing))
        if len(new):
            out[missing] = [n for k in range(0, len(new), 8192) for n in self._fresh(new.slice(k, 8192).to_pylist())]
            self._keep(new, out[missing])
        return out

    def _fresh(self, words: list[str]) -> list[int]:
        """count() for words behind a space: one of letters alone is a single pre-token, only others need to be cut."""
        whole = self.whole
        pieces = [(t,) if w.isalpha() else self.pieces(t) for w, t in ((w, f" {w}") for w in words)]
        rest = [p for p in dict.fromkeys(p for own in pieces for p in own) if p not in whole]
        found = {p: len(e.ids) for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True)} if rest else {}
        return [sum([found.get(p, 1) for p in own]) for own in pieces]

    def _keep(self, words: pa.Array, sizes: np.ndarray) -> None:
        short = pc.less_equal(pc.utf8_length(words), CACHE_CHARS).to_numpy(zero_copy_only=False)
        if len(self.words) + int(short.sum()) > CACHE_ENTRIES:
            stays = pc.less_equal(pc.utf8_length(self.words), CACHE_SHORT).to_numpy(zero_copy_only=False)
            stays &= int(stays.sum()) < CACHE_ENTRIES // 2
            self.words, self.sizes = self.words.filter(pa.array(stays)), self.sizes[stays]
        if int(short.sum()) <= CACHE_ENTRIES:
            self.words, self.sizes = pa.concat_arrays([self.words, words.filter(pa.array(short))]), np.concatenate([self.sizes, sizes[short]])

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow column, null as empty."""
        texts = pc.fill_null(texts, "")
        sizes, out, start, held = pc.binary_length(texts).to_numpy(), np.zeros(len(texts), np.int64), 0, 0
        for k, n in enumerate([*sizes.tolist(), SLICE_BYTES + 1]):
            if held and held + n > SLICE_BYTES:
                out[start:k] = self._count_slice(texts.slice(start, k - start))
                start, held = k, 0
            held += n
        return out

    def _count_slice(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, BESIDE)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        out = np.zeros(len(texts), np.int64)
        whole = odd.to_numpy(zero_copy_only=False)
        if whole.any():
            own = texts.filter(odd).to_pylist()
            out[whole] = [n for k in range(0, len(own), 64) for n in self.count(own[k : k + 64])]
        if not whole.all():
            out[~whole] = self._count_words(texts.filter(pc.invert(odd)))
        return out

    def _count_words(self, texts: pa.Array) -> np.ndarray:
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        n = self._word_counts(coded.dictionary)[coded.indices.to_numpy()]
        n[offsets[:-1]] = self.count(flat.take(pa.array(offsets[:-1])).to_pylist())  # no space stands before a text's first word
        return np.add.reduceat(n, offsets[:-1])


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter for each process and file; it holds the proved set and what it has merged."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: Callable[[], str], limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every whole text.

    path() gives the vocabulary file's place on the machine where it is called.
    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
    each; other columns aren't read. Empty tables give no rows.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        counts = counter(path())

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text")
            tokens = counts.count_column(texts)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return each

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
