"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest, one row per distinct
text ever kept, with the batch that brought it. A batch of new rows is reduced to
one row per digest, merged against the index with an anti-join on the bucket key
(the index side is not shuffled), and what is new is appended. A batch that comes
again, as after a lost job, is known by its name: its own rows in the index count
as new and are not appended twice. Only DataFrame operations run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import distinct_name, text_or_empty
from seqloom.runtime import Scratch, attach, remove

#: Digests that a bucket is meant for, about 250 MB; a new index gets as many buckets as its first batch or `expected` asks for.
BUCKET_ROWS = 4_000_000


class DigestIndex:
    """A bucketed, sorted table (digest binary, keep_id long, batch string) in the given folder.

    The number of buckets is set when the first batch comes: by `buckets`, or by
    how many digests are expected in all (at least those of the first batch).
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None, expected: int = 0):
        self.spark, self.path, self.buckets, self.expected = spark, path, buckets, expected
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, rows: int) -> None:
        """The empty table, if it isn't there, for a first batch of so many digests."""
        if self.exists():
            return
        wanted = -(-max(rows, self.expected) // BUCKET_ROWS)
        self.buckets = self.buckets or max(wanted, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def others(self, batch: str) -> DataFrame:
        """What other batches have brought."""
        return self.table().filter(F.col("batch") != batch)

    def new_only(self, rows: DataFrame, batch: str) -> DataFrame:
        """rows (one per digest) whose digest no other batch has brought: a sort-merge anti-join on the bucket key."""
        return rows.join(self.others(batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds rows of a batch, all or none; does nothing if the batch is there already."""
        if not self.table().filter(F.col("batch") == batch).isEmpty():
            return
        (
            rows.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"), F.lit(batch).alias("batch"))
            .repartition(self.bucket_count(), "digest")
            .write.format("parquet").mode("append").bucketBy(self.bucket_count(), "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def bucket_count(self) -> int:
        if not self.buckets:  # the table is an earlier run's
            said = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            self.buckets = int(said["Num Buckets"])
        return self.buckets

    def drop(self) -> None:
        """Take the table out of the catalog and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8, null text as empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"))


def batch_name(groups: DataFrame) -> str:
    """A name for what a batch holds, whatever its order: the same rows give the same name."""
    one = F.xxhash64("digest", "keep_id", "group_size")
    r = groups.agg(F.count("*"), F.coalesce(F.bit_xor(one), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(one, F.lit(1))), F.lit(0))).first()
    return "-".join(f"{v & (1 << 64) - 1:x}" for v in r)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    Texts are equal when identical; null text counts as empty. Of equal texts
    the row with the largest doc_id stays (a null doc_id is smaller than any
    other). Rows that repeat the same doc_id and text are copies like others:
    exactly one of them is kept. A text the index holds from another batch keeps
    nothing: keep_id is then the indexed row. New digests are appended to the
    index under the batch's name; without a name the batch is named by its
    content. The same batch again gives the same rows and adds nothing. Without
    an index one is made for this call and dropped. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    passing = index is None
    index = index or DigestIndex(spark, scratch.path("index"))
    # Repeats of one row collapse before anything is shuffled by digest alone.
    rows = scratch.keep(digests(docs).groupBy("doc_id", "digest").agg(F.count("*").alias("copies")), "digests")
    groups = scratch.keep(
        rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups"
    )
    batch = batch or batch_name(groups)
    index.create(groups.count())
    fresh = scratch.keep(index.new_only(groups, batch).select("digest", "keep_id"), "fresh")
    known = index.others(batch).join(groups.select("digest"), "digest", "left_semi").select("digest", F.col("keep_id").alias("known_id"))
    known = scratch.keep(known, "known")
    index.append(fresh, batch)
    if not known.isEmpty():
        groups = groups.join(known.withColumn("known", F.lit(True)), "digest", "left")
        groups = groups.select("digest", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.coalesce("known", F.lit(False)).alias("known"))
    else:
        groups = groups.withColumn("known", F.lit(False))
    if passing:
        index.drop()
    total = rows.agg(F.sum("copies")).first()[0] or 0
    found = attach(rows, groups, "digest", "group_size", total)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("known")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(
        "doc_id", "digest", "keep_id", "group_size", (stays & (F.col("copy") == 1)).alias("kept")
    )


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without the rows that deduplicate() drops, all columns kept.

    Where rows repeat the same doc_id and text (null and empty are the same text),
    the one whose columns come first as JSON stays. Other rows pass without being
    grouped. Columns may be of any type.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-filter")
    decided = scratch.keep(deduplicate(docs, index, batch), "decided")
    key_id, key_digest = distinct_name(docs, "gone_id"), distinct_name(docs, "gone_digest")
    kept = decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    kept = scratch.keep(kept.filter(~F.col("kept") | (F.col("copies") > 1)).select(F.col("doc_id").alias(key_id), F.col("digest").alias(key_digest), "kept"), "gone")
    scratch.drop(decided)
    gone, repeated = kept.select(key_id, key_digest), kept.filter("kept").select(key_id, key_digest)
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(key_id)) & (digest == F.col(key_digest))
    # A merge join whatever its size: a broadcast would end once many rows go, and disk then jumps.
    single = docs.join(gone.hint("merge"), same, "left_anti")
    if repeated.isEmpty():
        return single
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = (
        docs.join(repeated, same, "left_semi")
        .groupBy(F.col("doc_id").alias(key_id), digest.alias(key_digest))
        .agg(F.min_by(whole, F.to_json(whole)).alias(distinct_name(docs, "one")))
        .select(*(F.col(distinct_name(docs, "one"))[c].alias(c) for c in docs.columns))
    )
    return single.unionByName(one)
