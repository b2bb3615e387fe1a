"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.llm.shared import written


def components(edges: DataFrame, folder: str) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, the smallest node reachable.

    Each step hangs nodes on the smallest neighbour known; the steps end where
    an edge table no longer changes. Tables of the steps are written below
    ``folder``. Only counts reach the driver. A node with many edges is one
    pre-aggregated minimum and a join side that Spark may split.
    """
    pairs = written(_oriented(edges), f"{folder}/step0")
    step, seen = 0, None
    while True:
        # Large star: larger neighbours of u hang on the smallest neighbour of u (or u).
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = pairs.join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = written(_oriented(large.toDF("a", "b")), f"{folder}/large{step}")
        # Small star: smaller neighbours and the node itself hang on the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(least, "b").select(F.col("a").alias("x"), "m").union(least.select(F.col("b").alias("x"), "m"))
        step += 1
        pairs = written(_oriented(hung.toDF("a", "b")), f"{folder}/step{step}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with the smaller node first; loops go."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
