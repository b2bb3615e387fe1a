"""Seniority, minimum years and remote type of a posting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import blank_to_null, let, text_blob


def _word(pattern: str) -> str:
    return rf"(?iU)\b({pattern})\b"


def _years(blob: Column) -> Column:
    digits = F.regexp_extract(blob, f"(?i){vocab.YEARS_PATTERN}", 1)
    return blank_to_null(digits).try_cast("decimal(38,0)")


def _level(blob: Column) -> Column:
    years = _years(blob)
    return (
        F.when(blob.rlike(_word(vocab.SENIOR_WORDS)), "senior")
        .when(blob.rlike(_word(vocab.JUNIOR_WORDS)), "junior")
        .when(blob.rlike(_word(vocab.MID_WORDS)), "mid")
        .when(years >= 5, "senior")
        .when(years <= 2, "junior")
        .otherwise("mid")
    )


def experience_level(title: Column, description: Column) -> Column:
    return let(text_blob(title, description), _level)


def min_years(title: Column, description: Column) -> Column:
    """First number before "years", else the usual minimum of the level."""

    def pick(blob: Column) -> Column:
        level = _level(blob)
        usual = F.lit(None).cast("int")
        for name, years in vocab.LEVEL_YEARS.items():
            usual = F.when(level == name, years).otherwise(usual)
        return F.coalesce(_years(blob).try_cast("int"), usual)

    return let(text_blob(title, description), pick)


def remote_type_from_text(location: Column, description: Column) -> Column:
    blob = F.lower(
        F.concat_ws(" ", F.coalesce(location, F.lit("")), F.coalesce(description, F.lit("")))
    )
    return (
        F.when(blob.contains("remote"), "remote")
        .when(blob.contains("hybrid"), "hybrid")
        .when(blank_to_null(location).isNotNull(), "onsite")
    )


def remote_type_from_location(location: Column) -> Column:
    """Location-only rule, where hybrid wins over remote."""
    place = F.lower(blank_to_null(location))
    return (
        F.when(place.isNull(), F.lit(None))
        .when(place.contains("hybrid"), "hybrid")
        .when(place.rlike("remote|work from home|wfh"), "remote")
        .otherwise("onsite")
    )
