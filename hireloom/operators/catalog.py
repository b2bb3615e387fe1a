"""Search, order and page the posting catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom.operators import filters as f
from hireloom.session import new_path


def newest_first(df: DataFrame, posted: str = "posted_at", created: str = "created_at") -> list:
    return [
        F.col(posted).desc_nulls_last(),
        F.col(created).desc(),
        F.col("posting_id"),
    ]


def search(postings: DataFrame, filters: f.SearchFilters) -> DataFrame:
    """Every open posting that passes the filters."""
    return postings.filter(f.open_posting()).filter(f.matches(filters, mode="catalog"))


def page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first; planned as a top-k, not as a full sort."""
    return found.orderBy(*newest_first(found)).offset(offset).limit(limit)


def _after(name: str, value: object, descending: bool) -> Column:
    """Whether a column comes after a value in its order, nulls last."""
    column = F.col(name)
    if value is None:
        return F.lit(False)
    further = column < F.lit(value) if descending else column > F.lit(value)
    return further | column.isNull()


def next_page(found: DataFrame, cursor: tuple | None, limit: int = 50) -> DataFrame:
    """The page after a cursor ``(posted_at, created_at, posting_id)``, the last row of the page before.

    The cursor is a filter, so the top-k holds ``limit`` rows however far the
    reader is, and rows that came in since do not shift the pages.
    """
    if cursor is not None:
        later, same = F.lit(False), F.lit(True)
        for name, value, descending in zip(("posted_at", "created_at", "posting_id"), cursor, (True, True, False), strict=True):
            later = later | (same & _after(name, value, descending))
            same = same & F.col(name).eqNullSafe(F.lit(value))
        found = found.filter(F.coalesce(later, F.lit(False)))
    return page(found, limit)


class RankTable:
    """Search hits stored in their order, so that any page is read by its numbers.

    Rows are sorted by range partitions. A row's number is its place in the
    partition plus the rows of the partitions before; the latter are counts,
    one for each partition, which is all that the driver reads.
    """

    def __init__(self, found: DataFrame, name: str = "ranked", parts: int | None = None):
        spark = found.sparkSession
        self.path = new_path(spark, name)
        order = newest_first(found)
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # The id counts rows within a partition and holds the partition's number above.
        placed = found.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        placed = placed.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
        placed.write.partitionBy("_part").parquet(self.path)
        self.rows = spark.read.schema(placed.schema).parquet(self.path)
        held = self.rows.groupBy("_part").count().orderBy("_part").collect()
        self.before, self.total = {}, 0
        for part, n in held:
            self.before[part], self.total = self.total, self.total + n

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order, with their ``rank`` (from 1); only partitions that hold some are read."""
        ends = [*self.before.values(), self.total][1:]
        wanted = [p for (p, first), end in zip(self.before.items(), ends, strict=True) if first < offset + limit and end > offset]
        first = F.lit(0).cast("long")
        for part in wanted:
            first = F.when(F.col("_part") == part, F.lit(self.before[part])).otherwise(first)
        ranked = self.rows.filter(F.col("_part").isin(wanted)).withColumn("rank", first + F.col("_at") + 1)
        return ranked.filter(F.col("rank").between(offset + 1, offset + limit)).drop("_part", "_at").orderBy("rank")


def search_page(
    postings: DataFrame, filters: f.SearchFilters, limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page with the exact number of all hits beside each row."""
    found = search(postings, filters)
    total = found.select(F.count("*")).scalar()
    return page(found, limit, offset).withColumn("total", total)


def with_company(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Company columns beside each posting; a missing company gives nulls.

    No broadcast hint: Spark picks the strategy from the measured size.
    """
    return postings.join(companies, "company_id", "left")


def expire(postings: DataFrame, as_of: str) -> DataFrame:
    """Mark postings whose expiry has passed at a given time."""
    return postings.withColumn(
        "status",
        F.when(F.col("expires_at") < F.lit(as_of).cast("timestamp"), "expired").otherwise(
            F.col("status")
        ),
    )


def eligible(postings: DataFrame, preferences: DataFrame) -> DataFrame:
    """(profile, posting) pairs of a candidate list that break no hard limit.

    ``postings`` carries a profile_id per candidate row; preferences are keyed
    by it. Blocked companies are removed by an anti join on their key.
    """
    blocked = preferences.select(
        "profile_id", F.explode("blocked_companies").alias("company_key")
    ).distinct()
    kept = postings.join(blocked, ["profile_id", "company_key"], "left_anti")
    limits = preferences.select(
        "profile_id",
        F.col("locations").alias("_places"),
        F.col("remote_policy").alias("_policy"),
        F.col("salary_floor").alias("_floor"),
    )
    return (
        kept.join(limits, "profile_id", "left")
        .filter(f.within_constraints(F.col("_places"), F.col("_policy"), F.col("_floor")))
        .drop("_places", "_policy", "_floor")
    )
