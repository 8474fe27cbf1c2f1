"""Exact integers and rationals: built-in where 38 digits do, Python integers in Arrow batches beyond."""

from __future__ import annotations

from math import gcd, isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StructType([T.StructField("numerator", T.StringType()), T.StructField("denominator", T.StringType())]))
def reduced(numerator: pd.Series, denominator: pd.Series) -> pd.DataFrame:
    """A rational in lowest terms with a positive denominator; null where the denominator is zero."""

    def one(n: str | None, d: str | None) -> tuple[str | None, str | None]:
        if n is None or d is None or int(d) == 0:
            return None, None
        a, b = int(n), int(d)
        a, b = (-a, -b) if b < 0 else (a, b)
        g = gcd(a, b)
        return str(a // g), str(b // g)

    return pd.DataFrame([one(n, d) for n, d in zip(numerator, denominator)], columns=["numerator", "denominator"])


def compare_root(c: int, r: int, a: int, b: int) -> int:
    """Sign of c / sqrt(r) - a / b for r, b > 0, without rounding."""
    left, right = c * b, a
    ls, rs = (left > 0) - (left < 0), (right > 0) - (right < 0)
    if ls != rs:
        return 1 if ls > rs else -1
    d = left * left - right * right * r
    return ls * ((d > 0) - (d < 0))


def round_root(c: int, r: int, places: int = 12) -> int:
    """c / sqrt(r) times 10**places, rounded half to even, by integer roots."""
    scale = 10**places
    n = c * c * scale * scale
    whole = isqrt(n // r)
    # whole <= |x| < whole + 1; compare |x| with whole + 1/2
    half = (2 * whole + 1) ** 2 * r - 4 * n
    up = half < 0 or (half == 0 and whole % 2 == 1)
    return (1 if c >= 0 else -1) * (whole + up)


@F.pandas_udf(T.StringType())
def product(a: pd.Series, b: pd.Series) -> pd.Series:
    """The product of two integers in text, of any length."""
    return pd.Series([None if x is None or y is None else str(int(x) * int(y)) for x, y in zip(a, b)], dtype="object")


@F.pandas_udf(T.IntegerType())
def rho_at_least(covariance: pd.Series, radicand: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """1, 0 or -1 as covariance / sqrt(radicand) is above, at or below a / b; null where the radicand isn't positive."""
    return pd.Series([None if int(r) <= 0 else compare_root(int(c), int(r), int(x), int(y)) for c, r, x, y in zip(covariance, radicand, a, b)], dtype="Int32")


@F.pandas_udf(T.StringType())
def rho_text(covariance: pd.Series, radicand: pd.Series) -> pd.Series:
    """The correlation to 12 places, rounded half to even."""

    def one(c: str, r: str) -> str | None:
        if int(r) <= 0:
            return None
        v = round_root(int(c), int(r))
        return f"{'-' if v < 0 else ''}{abs(v) // 10**12}.{abs(v) % 10**12:012d}"

    return pd.Series([one(c, r) for c, r in zip(covariance, radicand)])


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """gcd of two bigints by Euclid's steps folded over an array: 92 steps do for 64 bits."""
    steps = F.sequence(F.lit(1), F.lit(92))
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    return F.aggregate(steps, start, lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % s["y"]).alias("y")), lambda s: s["x"])


def surd_sum_sign(terms: list[tuple[int, int]]) -> int:
    """Sign of the sum of c / sqrt(r) over terms (c, r > 0), exact.

    Each term is bounded by integer roots at growing precision. A sum of n such
    surds of at most b bits that isn't zero is larger than 2**-(b * 2**n), so a sum
    that small is zero.
    """
    terms = [(c, r) for c, r in terms if c]
    if not terms:
        return 0
    bits = max(max(abs(c).bit_length(), r.bit_length()) for c, r in terms) + 4
    places, most = 64, bits * 2 ** (len(terms) + 1)
    while True:
        scale = 1 << (2 * places)
        low = high = 0
        for c, r in terms:
            root = isqrt(c * c * scale // r)  # floor of |c| / sqrt(r) times 2**places
            low += root if c > 0 else -(root + 1)
            high += root + 1 if c > 0 else -root
        if low > 0:
            return 1
        if high < 0:
            return -1
        if places > most:
            return 0
        places *= 2


def delta_terms(candidate: tuple[int, int], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The surds of candidate - max(0, *others); a tuple is (covariance, radicand)."""
    best: tuple[int, int] = (0, 1)
    for o in others:
        if surd_sum_sign([o, (-best[0], best[1])]) > 0:
            best = o
    return [candidate, (-best[0], best[1])]


def compare_deltas(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> int:
    """Sign of one difference of correlations less another."""
    return surd_sum_sign([*left, *((-c, r) for c, r in right)])
