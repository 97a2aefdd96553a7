"""Shared-folder tables: how an operator cuts lineage without trusting any one executor's disk."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concordia.sources.tables import shared_folder


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives freed memory back to the system when its task ends. Workers serve many
    tasks of many queries, and allocators keep what the largest of them took."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return mapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of whole texts in an Arrow batch, so that a batch takes a few megabytes in the executor and its worker.
TEXT_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; with ``batch_rows``, in Arrow batches of so many
    rows while it is written.

    The copy survives lost executors, is compressed and column-pruned, and gives
    every later reader the same rows whatever the input plan would redo.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/concordia/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    try:
        spark.conf.set(_BATCH, batch_rows or before)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no plan reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_expression(id_col: str, cuts: list[int]) -> str:
    """SQL for the place of an id among sorted cuts: nested IFs of logarithmic depth; null counts as 0."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({id_col} <= {cuts[mid]}, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return f"IF({id_col} IS NULL, 0, {tree(0, len(cuts))})"
