"""Classification of catalogue records by exact tokens, word rules and pattern evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import normal_text


def token_set(value: Column) -> Column:
    """Distinct normalised parts of a list written with commas, semicolons, bars, slashes or line ends."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[,;|/\r\n]+"), lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def first_rule(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for label, condition in rules:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def clearly_modern(value: Column) -> Column:
    """Whether a date text speaks of modern times: in words, by a late century, or only by years from 1800 to 2100."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    return (
        F.when(text == "", False)
        .when(text.rlike(r"\b(modern|contemporary)\b"), True)
        .when(text.rlike(r"\b(b\.?\s*c\.?\s*e?\.?|before\s+(the\s+)?common\s+era)\b"), False)
        .when(text.rlike(r"\b(19th|20th|21st)\s+centur(y|ies)\b"), True)
        .otherwise((F.size(years) > 0) & F.forall(years, lambda y: (y >= 1800) & (y <= 2100)))
    )


def evidence(value: Column, pattern: str) -> Column:
    """Sorted distinct matches of a pattern, case folded, white space collapsed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit(f"({pattern})"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.trim(F.regexp_replace(m, r"\s+", " ")))))


def axes(fields: dict[str, list[str]]) -> Column:
    """Array of (axis, fields with text in them) for axes that have any."""
    made = [F.struct(F.lit(axis).alias("axis"), F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.lit(c)) for c in own))).alias("fields")) for axis, own in fields.items()]
    return F.filter(F.array(*made), lambda a: F.size(a["fields"]) > 0)


def qualified(counts: DataFrame, key: str, tokens: str, documents: str, least_tokens: int, least_documents: int) -> DataFrame:
    """Support gate: each class with its counts and whether both reach their thresholds."""
    return counts.withColumn("supported", (F.col(tokens) >= least_tokens) & (F.col(documents) >= least_documents)).select(key, tokens, documents, "supported")


def folded(value: Column) -> Column:
    """NFKC and case folding where text isn't ASCII."""
    return normal_text(value)
