"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hireloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Text work is heavy per byte, so small shuffles keep more tasks than by default.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too.

    A warehouse on the local disk is shared on one machine only, so elsewhere it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set and the warehouse is a local folder")
        configured = warehouse + "/_intermediate"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def materialize(
    df: DataFrame, name: str, spread: bool = False, folder: str | None = None
) -> DataFrame:
    """Write a step as a Parquet table in the shared folder and read it back.

    Used where a result feeds several later jobs: it survives lost executors,
    cuts the lineage and keeps column pruning and filter pushdown. ``spread``
    keeps a small table that later grows in a join in many files, so that the
    join starts with as many tasks as a shuffle would have. Tables below a
    ``folder`` can be removed together once nothing reads them.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(df.sparkSession, name)
    if spread:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
