"""Contact details found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import blank_to_null, first_items

EMAIL = f"(?i){vocab.EMAIL_PATTERN}"
URL = f"(?i)(?:{vocab.URL_PATTERN})"
CONTACT_PARTS = f"(?i){vocab.EMAIL_PATTERN}|{vocab.URL_PATTERN}"
CONTACT_LINE = f"(?i){vocab.EMAIL_PATTERN}|{vocab.PHONE_PATTERN}|{vocab.URL_PATTERN}"


def email(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, EMAIL, 0))


def phone(text: Column) -> Column:
    """The first number outside of mail addresses and links, whose digits are no phone number."""
    numbers = F.regexp_extract_all(text, F.lit(f"{CONTACT_PARTS}|({vocab.PHONE_PATTERN})"), F.lit(1))
    found = F.get(F.filter(numbers, lambda x: x != ""), F.lit(0))
    return F.trim(F.regexp_replace(found, r"(?U)\s+", " "))


def links(text: Column, limit: int | None = None) -> Column:
    """Distinct links in order."""
    return first_items(F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0))), limit)
