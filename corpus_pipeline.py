"""A corpus pipeline over `documents`: quality, exact copies, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents; the last returns packed
pieces. Null or empty texts, repeated rows and empty tables are handled as each
operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontamination, exact_dedup, near_text, packing, quality
from seqloom.llm.common import table
from seqloom.llm.queries import tokenizer_file
from seqloom.runtime import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.drop_near_copies(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_filter),
    ("near_dedup", near_filter),
    ("decontamination", benchmark_filter),
    ("packing", pack_windows),
]

#: Co-training and packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
