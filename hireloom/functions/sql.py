"""The most used keys as SQL functions, for people who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hireloom import vocab


def register(spark: SparkSession) -> None:
    stop = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION company_key(name STRING) RETURNS STRING RETURN "
        "coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ')), ''), 'unknown')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION skill_key(skill STRING) RETURNS STRING RETURN "
        r"trim(regexp_replace(lower(skill), '(?U)\\s+', ' '))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(body STRING) RETURNS ARRAY<STRING> "
        f"RETURN array_except(regexp_extract_all(lower(coalesce(body, '')), "
        f"'{vocab.TOKEN_PATTERN}', 0), array({stop}))"
    )
