"""Personal data, plain and disguised, with spans in the original text.

Plain identifiers are found in the text as it is. Where a text shows signs of a
disguise, transducers rewrite it (look-alike characters, spelled-out digits, "at"
and "dot" for @ and .), each keeping for every character it writes the source
characters it stands for. The same detectors then run on the rewritten text, and
what they find is mapped back and added unless it overlaps a plain identifier of
its kind without holding all of it and more; plain identifiers always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from seqloom.llm.common import with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[Span]:
    if "@" not in text:
        return
    parts, at, free = text.split("@"), 0, 0
    for before, rest in zip(parts, parts[1:]):
        sign = at + len(before)  # where this @ stands
        first = max(at + len(before.rstrip(_LOCAL)), free)
        if first < sign and (m := _DOMAIN.match(rest)):
            free = sign + 1 + m.end()
            yield first, free
        at = sign + 1


def ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, four = run.start(), []
        for number in run.group().split("."):
            four.append((at, number))
            at += len(number) + 1
            if not number:  # two dots in a row
                four = []
            elif len(four) == 4:
                if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for _, n in four):
                    yield four[0][0], at - 1
                four = []


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))

# Characters that look like an ASCII one, beyond full-width forms and the decimal digits of other scripts.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοαινρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡıℓ‐‑‒–—―−﹣․。｡﹒﹫⓪①②③④⑤⑥⑦⑧⑨   ",
        "aeopcyxijshdqwABEKMHOPCTYXIJSoaivptuxABEZHIKMNOPTYXagil--------....@0123456789\x20\x20\x20",
        strict=True,
    )
)
# Characters without width.
NO_WIDTH = "­​‌‍⁠﻿"
# Spelled-out digits and signs.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + "".join(map(re.escape, [*LOOK_ALIKES, *NO_WIDTH])) + "！-～٠-٩۰-۹०-९]")
_OPEN, _SHUT = r"[\[({<]\x20{0,2}", r"\x20{0,2}[\])}>]"
_AT_SIGN = re.compile(rf"[\x20_-]{{0,2}}{_OPEN}at{_SHUT}[\x20_-]{{0,2}}", re.I)
_DOT_SIGN = re.compile(rf"[\x20_-]{{0,2}}{_OPEN}(?:dot|punkt|point|punto){_SHUT}[\x20_-]{{0,2}}", re.I)
_BRACKETED = re.compile(rf"{_OPEN}(?:at|dot|punkt|point|punto){_SHUT}", re.I)
#: Stands for a bracketed dot until "at" has been read: "at" counts only before a disguised dot.
_DOT = "\ufdd0"
_HOST, _ANY_DOT = r"[A-Za-z0-9-]{1,63}", rf"(?:\.|{_DOT}|\x20dot\x20)"
#: name at host dot end, words and signs in any mix.
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]{{1,64}}(?:{_ANY_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,4}}(?:@|\x20at\x20(?=[A-Za-z0-9.-]{{1,255}}(?:{_DOT}|\x20dot\x20))){_HOST}(?:{_ANY_DOT}{_HOST}){{1,4}}(?![A-Za-z0-9-])", re.I
)
_SIGNS = re.compile(r"\x20(at|dot)\x20", re.I)
_LETTERS = re.compile("[a-z]+")
_DOT_MARK = re.compile(_DOT)
_NAME = "(?:" + "|".join(DIGITS) + ")"
#: At least three digit words; "plus" may come first, "dot", "point" or "dash" between.
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[\x20-])?{_NAME}(?:[\x20,-]{{1,2}}(?:(?:dot|point|dash)[\x20-])?{_NAME}){{2,}}(?![A-Za-z])", re.I)
_SPELLED_WORD = re.compile(rf"{_NAME}|plus|dot|point|dash|[\x20,-]+", re.I)
_WORDS = frozenset(DIGITS)
_HYPHENED = re.compile(rf"-{_NAME}-", re.I)


class Rewritten:
    """A text with, for each character, the half-open range of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def apply(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace each match by pieces (characters, from, to): what stands for that part of the match."""
        out, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[last : m.start()])
            start += self.start[last : m.start()]
            end += self.end[last : m.start()]
            for chars, a, b in write(m):
                out.append(chars)
                start += [self.start[a]] * len(chars)
                end += [self.end[b - 1]] * len(chars)
            last = m.end()
        if last:
            self.text = "".join(out) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]


def _plain_char(m: re.Match) -> list[tuple[str, int, int]]:
    c, (a, b) = m.group(), m.span()
    if c in NO_WIDTH:
        return []
    if c in LOOK_ALIKES:
        return [(LOOK_ALIKES[c], a, b)]
    if "！" <= c <= "～":
        return [(chr(ord(c) - 0xFEE0), a, b)]
    return [(str(unicodedata.decimal(c)), a, b)]


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    signs = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}
    words = [(w.group().lower(), m.start() + w.start(), m.start() + w.end()) for w in _SPELLED_WORD.finditer(m.group())]
    return [(DIGITS.get(w) or signs[w], a, b) for w, a, b in words if w in DIGITS or w in signs]


def _spoken(m: re.Match) -> list[tuple[str, int, int]]:
    """name at host dot end: the words become signs, the rest stays character by character."""
    out, k, text = [], 0, m.group()
    for w in _SIGNS.finditer(text):
        out += [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(text[k : w.start()], k)]
        out.append(("@" if w.group(1).lower() == "at" else ".", m.start() + w.start(), m.start() + w.end()))
        k = w.end()
    return out + [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(text[k:], k)]


def disguised(text: str) -> bool:
    """Whether a transducer could change the text."""
    if not text.isascii() and _ODD.search(text):
        return True
    if _BRACKETED.search(text) or _HYPHENED.search(text):
        return True
    words = set(_LETTERS.findall(text.lower()))
    return ("dot" in words and ("at" in words or "@" in text)) or not words.isdisjoint(_WORDS)


def rewrite(text: str) -> Rewritten:
    r = Rewritten(text)
    r.apply(_ODD, _plain_char)
    r.apply(_AT_SIGN, lambda m: [("@", *m.span())])
    r.apply(_DOT_SIGN, lambda m: [(_DOT, *m.span())])
    r.apply(_SPOKEN, _spoken)
    r.apply(_DOT_MARK, lambda m: [(".", *m.span())])
    r.apply(_SPELLED, _digits)
    return r


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain identifiers and all identifiers, as (start, end, kind) sorted by start, then by kind as KINDS lists them."""
    plain = {kind: list(finder(text)) for kind, finder in FINDERS.items()}
    every = plain
    if disguised(text) and (r := rewrite(text)).text != text:
        every = {}
        for kind, finder in FINDERS.items():
            own = list(plain[kind])
            starts, ends = [a for a, _ in own], [b for _, b in own]
            for a, b in finder(r.text):
                a, b = r.start[a], r.end[b - 1]
                k = bisect_left(starts, b)
                j = bisect_right(ends, a)  # plain spans j to k overlap this one
                whole = j >= k or (a <= starts[j] and ends[k - 1] <= b and (a, b) != plain[kind][j])
                if whole and not (own[len(starts) :] and own[-1][1] > a):
                    own.append((a, b))
            every[kind] = own
    order = {kind: k for k, kind in enumerate(KINDS)}
    line = lambda found: sorted(((a, b, kind) for kind, own in found.items() for a, b in own), key=lambda s: (s[0], order[s[2]], s[1]))
    return line(plain), line(every)


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The four counts and base_sha256 are of plain identifiers; spans and n_spans
    hold the disguised ones too. Offsets are code points of the original text,
    ends exclusive. Null and empty texts hold nothing; repeated rows are scanned
    each; empty tables give no rows. Every detector is linear in the text.
    """

    def make() -> Callable[[list[str | None]], list[list]]:
        def each(texts: list[str | None]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for text in texts:
                plain, every = find(text or "")
                counts = [sum(s[2] == kind for s in plain) for kind in KINDS]
                for column, value in zip(out, (*counts, hashlib.sha256(_join(plain).encode()).hexdigest(), _join(every), len(every)), strict=True):
                    column.append(value)
            return out

        return each

    added = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
    return with_columns(docs.select("doc_id", "text"), added, "text", make).drop("text")
