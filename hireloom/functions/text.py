"""String columns shared by every job: keys, token sets, cleaners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once so that a lambda body does not compute it per element."""
    return F.transform(F.array(value), body)[0]


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def str_array(values: list[str]) -> Column:
    """A constant list, written as one SQL literal to keep plan building quick."""
    if not values:
        return F.expr("cast(array() AS array<string>)")
    return F.expr(f"array({', '.join(_sql_text(v) for v in values)})")


def str_map(pairs: dict[str, str]) -> Column:
    """A constant lookup table."""
    return F.expr(
        "map(" + ", ".join(f"{_sql_text(k)}, {_sql_text(v)}" for k, v in pairs.items()) + ")"
    )


#: What ``\\s`` means with ``(?U)``. Trimming by characters looks at the ends only, a pattern at every place.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Null for empty text. The value is bound once, so nested use stays small."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def first_items(items: Column, limit: int | None) -> Column:
    """The first items of a list; all of them without a limit."""
    return items if limit is None else F.slice(items, 1, limit)


def clean(c: Column) -> Column:
    return blank_to_null(strip(c))


def clean_or_null_word(c: Column) -> Column:
    """As ``clean``; the words null, none, n/a and na count as missing too."""
    missing = ["", *vocab.NULL_WORDS]
    return F.get(F.filter(F.array(strip(c)), lambda x: ~F.lower(x).isin(missing)), F.lit(0))


def company_key(name: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.coalesce(blank_to_null(key), F.lit("unknown"))


def skill_key(skill: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(skill), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens without stop words; missing text gives none."""
    found = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(vocab.TOKEN_PATTERN), F.lit(0)
    )
    return F.array_except(found, str_array(vocab.STOP_WORDS))


def text_blob(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def title_case(text: Column) -> Column:
    """Capitalise each run of letters, so ``ci/cd`` gives ``Ci/Cd``."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def is_lower(text: Column) -> Column:
    return (text == F.lower(text)) & text.rlike(r"\p{L}")


def string_list(text: Column, separators: str = r"[,;\n]") -> Column:
    """A separated string as a list of non-empty trimmed parts."""
    parts = F.transform(F.split(text, separators), strip)
    return F.filter(parts, lambda p: p != "")


def clean_list(items: Column) -> Column:
    """Trim the items of a list and drop missing or empty ones."""
    return F.filter(F.transform(items, strip), lambda p: p.isNotNull() & (p != ""))


def checksum(*columns: str) -> Column:
    """sha256 over key-sorted JSON that keeps null fields."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)
