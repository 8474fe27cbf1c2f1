"""Small pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.runtime import ship_package

#: A-Z to a-z and nothing else, for str.translate.
LOWER_ASCII = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow where make() runs once in each task and returns what turns a batch of rows into a batch of results."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out
        pa.default_memory_pool().release_unused()  # workers live on, so what a task has freed should go back

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, added: str, column: str, make: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """df with columns computed by Python from one of its columns; all its own columns pass through as they are.

    make() returns a function from a list of values to one list for each added
    column. Added names must not be among df's columns.
    """
    extra = T._parse_datatype_string(added)
    clash = {f.name.lower() for f in extra} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    kinds = [(f.name, _ARROW[f.dataType.simpleString()]) for f in extra]

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        each = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = each(batch.column(column).to_pylist())
            return pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, k) for v, (_, k) in zip(found, kinds, strict=True))],
                names=[*batch.schema.names, *(n for n, _ in kinds)],
            )

        return one

    return map_batches(df, T.StructType([*df.schema.fields, *extra.fields]), start)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def distinct_name(df: DataFrame, wanted: str) -> str:
    """wanted, or a longer name if df has that column already."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted += "_"
    return wanted


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
