"""Provider records mapped to the common observation columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom import schemas, vocab
from hireloom.functions.classify import remote_type_from_location
from hireloom.functions.dates import iso_timestamp
from hireloom.functions.text import blank_to_null, str_array


def to_observations(df: DataFrame, **columns: Column) -> DataFrame:
    """Select the observation columns; those not given are null."""
    return df.select(
        *[
            columns.get(name, F.lit(None)).cast(kind).alias(name)
            for name, kind in schemas.OBSERVATION.items()
        ]
    )


def _requirements(
    skills: Column,
    job_type: Column | None = None,
    category: Column | None = None,
    match_score: Column | None = None,
    source: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        F.coalesce(skills, str_array([])).alias("skills"),
        (null if job_type is None else job_type).cast("string").alias("job_type"),
        (null if category is None else category).cast("string").alias("category"),
        (null if match_score is None else match_score).cast("int").alias("match_score"),
        (null if source is None else source).cast("string").alias("source"),
    )


def _salary_only(salary: Column) -> Column:
    text = blank_to_null(salary)
    return F.when(
        text.isNotNull(),
        F.struct(
            F.lit(None).cast("string").alias("currency"),
            F.lit(None).cast("double").alias("min"),
            F.lit(None).cast("double").alias("max"),
            text.alias("salary"),
        ),
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Dumps of the remote-jobs listing: one JSON object with a jobs array per file."""
    dumps = spark.read.schema(f"jobs array<{schemas.LISTING_ITEM}>").json(path, multiLine=True)
    return from_listing(dumps.select(F.explode("jobs").alias("job")))


def from_listing(items: DataFrame, column: str = "job") -> DataFrame:
    """Map listing items; the id falls back to the url and then to the title."""
    item = F.col(column)
    url = item["url"]
    return to_observations(
        items,
        provider=F.lit("remotive"),
        external_id=F.coalesce(
            F.nullif(blank_to_null(item["id"]), F.lit("0")),
            blank_to_null(url),
            item["title"],
        ),
        title=F.coalesce(blank_to_null(item["title"]), F.lit(vocab.UNTITLED_ROLE)),
        company_name=F.coalesce(
            blank_to_null(item["company_name"]), F.lit(vocab.UNKNOWN_COMPANY)
        ),
        description=item["description"],
        location=F.coalesce(
            blank_to_null(item["candidate_required_location"]), F.lit("Remote")
        ),
        remote_type=F.lit("remote"),
        canonical_url=url,
        source_url=url,
        posted_at=iso_timestamp(item["publication_date"]),
        compensation=_salary_only(item["salary"]),
        requirements=_requirements(item["tags"], item["job_type"], item["category"]),
        company_industry=item["category"],
        raw_payload=F.to_json(item),
    )


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return from_search_results(spark.read.schema(schemas.SEARCH_RESULT).json(path))


def from_search_results(rows: DataFrame) -> DataFrame:
    """Map search results, whose level was already filtered by the provider."""
    title = F.coalesce(blank_to_null(F.col("title")), F.lit(vocab.UNTITLED_ROLE))
    company = F.coalesce(blank_to_null(F.col("company")), F.lit(vocab.UNKNOWN_COMPANY))
    return to_observations(
        rows,
        provider=F.lit(vocab.LEVEL_FILTERED_PROVIDER),
        external_id=F.coalesce(
            blank_to_null(F.col("id")), F.concat(company, F.lit(":"), title)
        ),
        title=title,
        company_name=company,
        location=blank_to_null(F.col("location")),
        remote_type=remote_type_from_location(F.col("location")),
        canonical_url=F.col("url"),
        source_url=F.col("url"),
        posted_at=F.col("found_at"),
        compensation=_salary_only(F.col("salary")),
        requirements=_requirements(
            F.col("skills_required"),
            match_score=F.col("match_score"),
            source=F.lit(vocab.LEVEL_FILTERED_PROVIDER),
        ),
        raw_payload=F.to_json(F.struct("*")),
    )


def search_seed(postings: DataFrame, query: str | None) -> DataFrame:
    """Coarse search of a seed table over title, company, description and skills."""
    q = (query or "").strip().lower()
    if not q:
        return postings
    hit = F.exists(
        F.coalesce(F.col("requirements.skills"), str_array([])),
        lambda s: F.lower(s).contains(q),
    )
    for name in ("title", "company_name", "description"):
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(q)
    return postings.filter(hit)


def provider_rank(provider: Column) -> Column:
    rank = F.lit(len(vocab.PROVIDER_RANK))
    for name, value in vocab.PROVIDER_RANK.items():
        rank = F.when(provider == name, value).otherwise(rank)
    return rank


def union_providers(*parts: DataFrame) -> DataFrame:
    """All observations together, with the rank of their provider."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.withColumn("provider_rank", provider_rank(F.col("provider")))


def provider_report(observations: DataFrame, expected: list[str]) -> DataFrame:
    """Rows fetched per expected provider, with a warning where none came."""
    wanted = observations.sparkSession.createDataFrame([(p,) for p in expected], "provider string")
    counts = observations.groupBy("provider").agg(F.count("*").alias("fetched"))
    n = F.coalesce(F.col("fetched"), F.lit(0))
    return wanted.join(counts, "provider", "left").select(
        "provider",
        n.cast("bigint").alias("fetched"),
        F.when(n == 0, F.concat("provider", F.lit(" returned no jobs for these filters.")))
        .otherwise(F.concat("provider", F.lit(" fetched "), n.cast("string"), F.lit(" jobs.")))
        .alias("warning"),
    )
