"""Timestamps and free-text date ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import blank_to_null, let

_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
)
_RANGE = rf"(?iU)({vocab.DATE_TOKEN})\s*[-–—to]+\s*({vocab.DATE_TOKEN}|{vocab.PRESENT})"
_TRAILING = (
    rf"(?iU)\s+({vocab.DATE_TOKEN})\s*[-–—to]+\s*({vocab.DATE_TOKEN}|{vocab.PRESENT})\s*$"
)


def iso_timestamp(text: Column) -> Column:
    """ISO text as a UTC timestamp; text without a zone is UTC; bad text is null."""
    return F.when(text.rlike(_ISO), text).try_cast("timestamp")


def is_present(text: Column) -> Column:
    return F.lower(text).isin(vocab.PRESENT_WORDS)


def has_range(text: Column) -> Column:
    """Whether a text holds a range. Each range has a year, which is found much sooner."""
    return text.rlike(r"(?U)\d{4}") & text.rlike(_RANGE)


def has_date(text: Column) -> Column:
    return text.rlike(rf"(?iU)\b({vocab.DATE_TOKEN}|{vocab.PRESENT})\b")


def date_range(text: Column) -> Column:
    """start, end and is_current of a date range, and the text around it.

    A range at the end wins over one inside the text. A range up to now is
    current and has no end.
    """

    def found(t: Column, pattern: str) -> Column:
        def parts(end: Column) -> Column:
            current = F.coalesce(is_present(end), F.lit(False))
            rest = F.regexp_replace(t, pattern, "")
            return F.struct(
                blank_to_null(F.regexp_extract(t, pattern, 1)).alias("start"),
                F.when(~current, blank_to_null(end)).alias("end"),
                current.alias("is_current"),
                F.regexp_replace(rest, r"^[ |·•\-–—]+|[ |·•\-–—]+$", "").alias("rest"),
            )

        return let(F.regexp_extract(t, pattern, 2), parts)

    def read(t: Column) -> Column:
        null = F.lit(None).cast("string")
        none = F.struct(
            null.alias("start"), null.alias("end"), F.lit(False).alias("is_current"), t.alias("rest")
        )
        # A text without any range has none at its end either.
        dated = F.when(t.rlike(_TRAILING), found(t, _TRAILING)).otherwise(found(t, _RANGE))
        return F.when(has_range(t), dated).otherwise(none)

    return let(text, read)


def parsed_date(text: Column) -> Column:
    """First day of a free-text month or year; null when it is neither."""
    month = F.concat(F.initcap(F.substring(F.trim(text), 1, 3)), F.lit(" "), F.right(text, F.lit(4)))
    return F.coalesce(
        F.when(
            text.rlike(rf"(?i)^\s*{vocab.MONTH}\.?\s+\d{{4}}\s*$"),
            F.try_to_date(month, "MMM yyyy"),
        ),
        F.when(F.trim(text).rlike(r"^\d{4}$"), F.try_to_date(F.trim(text), "yyyy")),
    )
