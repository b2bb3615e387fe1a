"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse, which is shared too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder for tables that nothing needs after the block."""
    path = new_folder(spark, name)
    try:
        yield path
    finally:
        remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Send texts to Python in batches of at most ``most`` bytes, unless the session asks for smaller ones.

    The default of 64 MB is held several times over by each task: as rows, as
    Arrow data on both sides and as Python objects.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
    if size <= 0 or size > most:
        spark.conf.set(key, str(most))


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes in a text column, and one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


_CACHES: list[dict] = []


def caches(*found: dict) -> None:
    """Name the caches of an operator that outlive its tasks in a Python worker."""
    _CACHES.extend(found)


def claim(*mine: dict) -> None:
    """Empty the caches of the other operators: a worker serves one stage after another and keeps what the present one needs."""
    for other in _CACHES:
        if not any(other is m for m in mine):
            other.clear()
    pa.default_memory_pool().release_unused()
