"""Similarity over embedding columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def mean_vector(column: str, width: int) -> Column:
    """Element-wise mean as an aggregate over plain averages, without exploding."""
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(width)])


def nearest(vectors: DataFrame, query: Column, k: int, column: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, as a top-k over one scan."""
    return (
        vectors.withColumn("_query", query)
        .withColumn("similarity", cosine(F.col(column), F.col("_query")))
        .drop("_query")
        .orderBy(F.desc("similarity"), "vec_id")
        .limit(k)
    )
