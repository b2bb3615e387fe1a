"""Order-dependent steps that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key. Spark cuts each partition to one row a key before the shuffle and carries the columns that are read only."""
    return _first(df, keys, [F.asc(c) for c in order])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, the same way."""
    return _first(df, keys, [F.desc(c) for c in order])


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    chunk: Column,
    following: bool = False,
) -> DataFrame:
    """Value of the previous (or following) row per key.

    The window runs per (key, chunk), where the chunk is a slice of the
    order such as a day, so that a hot key spreads over many tasks. Only one
    boundary row per chunk travels along the key to link the chunks; it comes
    from the rows as they are dealt for the first window, not from another shuffle.
    """
    boxed = F.struct(value.alias("v"))
    chunked = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    shift, back = (F.lead, F.lag) if following else (F.lag, F.lead)
    links = (
        chunked.withColumn("_beyond", back(boxed).over(inside))
        .where(F.col("_beyond").isNull())
        .select(*keys, "_chunk", boxed.alias("_edge"))
        .select(*keys, "_chunk", shift("_edge").over(along).alias("_link"))
    )
    return (
        chunked.withColumn("_near", shift(boxed).over(inside))
        .join(links, [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_link")["v"])
        .drop("_chunk", "_near", "_link")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; Spark cuts each partition to k before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
