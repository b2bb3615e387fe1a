"""Skill lists: dictionary tagging, display forms, normalised sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.text import clean_list, first_items, is_lower, let, skill_key, str_array, str_map, title_case


def _term_table() -> Column:
    """Terms longest first, each with the longer terms that cover it."""
    ordered = sorted(vocab.SKILL_TERMS, key=len, reverse=True)
    rows = []
    for term in ordered:
        covers = [t for t in ordered if term in t and t != term]
        rows.append(F.struct(F.lit(term).alias("term"), str_array(covers).alias("covers")))
    return F.array(*rows)


def inferred_skills(text: Column, limit: int | None = None) -> Column:
    """Dictionary terms found in the text, longest first.

    A term is skipped when a longer term that contains it is present too.
    """

    def tag(body: Column) -> Column:
        present = F.filter(
            _term_table(),
            lambda t: body.contains(t["term"])
            & ~F.exists(t["covers"], lambda longer: body.contains(longer)),
        )
        return first_items(F.transform(present, lambda t: t["term"]), limit)

    return let(F.lower(text), tag)


def display_skill(skill: Column) -> Column:
    shown = F.when(is_lower(skill), title_case(skill)).otherwise(skill)
    return F.coalesce(F.try_element_at(str_map(vocab.SKILL_DISPLAY), skill), shown)


def title_skill(skill: Column) -> Column:
    return F.when(is_lower(skill), title_case(skill)).otherwise(skill)


def skill_set(skills: Column) -> Column:
    """Sorted distinct normalised skills; a missing list gives an empty set."""
    keys = F.transform(F.coalesce(skills, str_array([])), skill_key)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != ""))))


def skills_from_variant(items: Column) -> Column:
    """Skills given as strings or as objects with a name or skill field."""
    rows = F.try_variant_get(items, "$", "array<variant>")

    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        named = F.coalesce(
            F.nullif(F.try_variant_get(v, "$.name", "string"), F.lit("")),
            F.try_variant_get(v, "$.skill", "string"),
        )
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(
            kind.startswith("OBJECT"), named
        )

    return F.coalesce(clean_list(F.transform(rows, one)), str_array([]))
