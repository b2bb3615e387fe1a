"""Predicates over postings, resumes, matches and applications."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.classify import experience_level, min_years
from hireloom.functions.text import blank_to_null, let, str_array, text_blob


@dataclass(frozen=True)
class SearchFilters:
    query: str | None = None
    location: str | None = None
    country: str | None = None
    remote_type: str | None = None
    skills: list[str] = field(default_factory=list)
    experience_level: str | None = None
    min_experience_years: int | None = None

    def wanted(self, name: str) -> str | None:
        """A text filter in lower case, or None where it is empty or "any"."""
        value = (getattr(self, name) or "").strip().lower()
        return None if value in ("", "any") else value


def level_filtered_at_source(by: Column | None = None) -> Column:
    """Postings whose provider filtered by level itself, told by a source tag or, without one, by the provider."""
    return F.coalesce((F.col("provider") if by is None else by) == vocab.LEVEL_FILTERED_PROVIDER, F.lit(False))


def free_text(query: str) -> Column:
    blob = text_blob(F.col("title"), F.col("description"), F.col("location"))
    return blob.contains(query.strip().lower())


def catalog_text(query: str, wildcards: bool = False) -> Column:
    """Case-blind match on title, description or location.

    ``wildcards=True`` lets % and _ in the query act as patterns.
    """
    text = query.strip()
    if not wildcards:
        text = text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    hit = F.lit(False)
    for name in ("title", "description", "location"):
        hit = hit | F.coalesce(F.col(name).ilike(f"%{text}%"), F.lit(False))
    return hit


def location_has(place: str) -> Column:
    return F.lower(F.coalesce("location", F.lit(""))).contains(place.strip().lower())


def country_in(country: str, word_boundary: bool = False) -> Column:
    """Any place name of the country in location or description.

    The plain form looks for substrings, so "us" also hits "focus".
    """
    name = country.strip().lower()
    needles = vocab.COUNTRY_NEEDLES.get(name, [name])
    blob = text_blob(F.col("location"), F.col("description"))
    if word_boundary:
        joined = "|".join(needles)
        return blob.rlike(rf"(?U)\b({joined})\b")
    return let(blob, lambda b: F.exists(str_array(needles), lambda n: b.contains(n)))


def remote_is(want: str, mode: str = "discover") -> Column:
    """Discovery takes unknown and worldwide as remote; the catalog is strict."""
    want = want.lower()
    if mode == "catalog":
        return F.col("remote_type") == want
    have = F.lower(F.coalesce("remote_type", F.lit("")))
    if want == "remote":
        return have.isin("", "remote", "worldwide")
    return have == want


def any_skill(skills: list[str], listed: str = "skills") -> Column:
    blob = text_blob(F.col("title"), F.col("description"), F.concat_ws(" ", F.col(listed)))
    wanted = str_array([s.lower() for s in skills])
    return let(blob, lambda b: F.exists(wanted, lambda s: b.contains(s)))


def level_is(level: str, by: Column | None = None) -> Column:
    return level_filtered_at_source(by) | (
        experience_level(F.col("title"), F.col("description")) == level.lower()
    )


def years_at_least(years: int, by: Column | None = None) -> Column:
    """Drops only junior postings that ask for fewer years."""
    too_junior = (min_years(F.col("title"), F.col("description")) < years) & (
        experience_level(F.col("title"), F.col("description")) == "junior"
    )
    return level_filtered_at_source(by) | ~F.coalesce(too_junior, F.lit(False))


def open_posting() -> Column:
    return F.col("status").isin(vocab.OPEN_POSTING_STATES)


def score_at_least(min_score: float) -> Column:
    return F.col("score") >= min_score


def not_cancelled() -> Column:
    return F.col("status") != "cancelled"


def owned_by(profile_id: object) -> Column:
    value = profile_id if isinstance(profile_id, Column) else F.lit(profile_id)
    return F.col("profile_id") == value


def usable_resume() -> Column:
    return F.col("status").isin(vocab.USABLE_RESUME_STATES) & F.col("content_id").isNotNull()


def origin(source_object_key: Column) -> Column:
    return F.when(blank_to_null(source_object_key).isNotNull(), "uploaded").otherwise("generated")


def origin_is(wanted: str | None) -> Column:
    if wanted not in ("uploaded", "generated"):
        return F.lit(True)
    return origin(F.col("source_object_key")) == wanted


def matches(filters: SearchFilters, mode: str = "discover", skills: str = "skills", source: Column | None = None) -> Column:
    """All filters of a search as one predicate.

    ``source`` is the tag by which a posting says who filtered it by level;
    such postings pass the filters of level and years. When postings are
    discovered with a level filter, those of that provider pass both too.
    """
    parts, by = [], source
    if source is not None and mode == "discover" and filters.wanted("experience_level"):
        by = F.when(level_filtered_at_source(), F.lit(vocab.LEVEL_FILTERED_PROVIDER)).otherwise(source)
    if filters.query and filters.query.strip():
        parts.append(
            catalog_text(filters.query) if mode == "catalog" else free_text(filters.query)
        )
    if filters.wanted("location"):
        parts.append(location_has(filters.location))
    if filters.country:
        parts.append(country_in(filters.country))
    if filters.wanted("remote_type"):
        parts.append(remote_is(filters.wanted("remote_type"), mode))
    if filters.skills:
        parts.append(any_skill(filters.skills, skills))
    if filters.wanted("experience_level"):
        parts.append(level_is(filters.wanted("experience_level"), by))
    if filters.min_experience_years is not None:
        parts.append(years_at_least(filters.min_experience_years, by))
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def within_constraints(
    locations: Column, remote_policy: Column, salary_floor: Column | None = None
) -> Column:
    """Hard limits of a preference set; an empty limit allows everything."""
    place_ok = (F.coalesce(F.size(locations), F.lit(0)) <= 0) | F.exists(
        locations, lambda p: F.lower(F.coalesce("location", F.lit(""))).contains(F.lower(p))
    )
    remote_ok = remote_policy.isNull() | F.coalesce(
        F.col("remote_type") == remote_policy, F.lit(False)
    )
    pay_ok = F.lit(True)
    if salary_floor is not None:
        # A posting that states no pay is not judged by it.
        pay_ok = F.coalesce(F.col("pay_min") >= salary_floor, F.lit(True))
    return F.coalesce(place_ok, F.lit(True)) & remote_ok & pay_ok
