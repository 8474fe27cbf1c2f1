"""An ingestion gate as a stream: each batch of artifacts is validated and meets the leakage index before it is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import validation
from seqloom.plans.commands import evidence
from seqloom.sources.artifacts import ARTIFACT


def artifact_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New JSON Lines files of a folder, by the fixed schema."""
    return spark.readStream.schema(ARTIFACT).option("maxFilesPerTrigger", files_a_batch).json(folder)


def gate(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Store admitted artifacts, issues and evidence below out, a folder for each batch; runs until it has caught up.

    A batch's folder is replaced if the batch is run again after a failure, so
    every artifact is stored once. An artifact with errors is set aside whole.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            issues = validation.validate(rows)
            issues.write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
            broken = rows.sparkSession.read.schema(issues.schema).parquet(f"{out}/issues/batch={number}").filter("severity = 'error'").select("artifact_id").distinct()
            good = rows.join(broken, rows["artifact_id"].eqNullSafe(broken["artifact_id"]), "left_anti")
            good.write.mode("overwrite").parquet(f"{out}/artifacts/batch={number}")
            evidence(good).write.mode("overwrite").parquet(f"{out}/evidence/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_evidence(spark: SparkSession, out: str) -> DataFrame:
    """(kind, value, artifacts) of evidence that more than one stored artifact holds."""
    held = spark.read.schema("artifact string, kind string, value string, batch int").parquet(f"{out}/evidence")
    return held.groupBy("kind", "value").agg(F.array_sort(F.collect_set("artifact")).alias("artifacts")).filter(F.size("artifacts") > 1)
