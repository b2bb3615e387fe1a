"""Loose resume JSON to the canonical content struct: aliases, repair, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom import schemas, vocab
from hireloom.functions.dates import is_present
from hireloom.functions.text import (
    blank_to_null, checksum, clean, clean_or_null_word, let, str_array, strip, string_list,
    word_count,
)

_BULLET_MARK = vocab.BULLET_MARK
_LEAK = rf"(?iU)\b({vocab.SECTION_LEAK})\b"
_ONLY_LEAK = rf"(?i)^({vocab.SECTION_LEAK})$"
_VERB = rf"(?iU)\b({vocab.ACTION_VERBS})\b"
_PROGRAMMING = rf"(?i)^({vocab.PROGRAMMING_LANGUAGES})$"
# Dates in titles, headings that leak into other fields, and words that open them.
_MONTHS = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}|\d{4}"
_TITLE_DATES = rf"(?i)\s+({_MONTHS})\s*[-–—to]+\s*({_MONTHS}|Present|Current|Now)\s*$"
_LEAKED_HEADING = (
    r"(?is)\n\s*(?:skills?|technical skills|experience|work experience|projects?|education)\s*$"
)
_NOT_A_PROJECT = r"(?i)^(education|certification|skills|awards|experience)"
_NOT_A_CERTIFICATE = r"(?i)^(project|education|skills)"
# End of the fixed values.


def parse_object(text: Column) -> Column:
    """A JSON object from plain, fenced or noisy text; null when there is none."""
    bare = F.regexp_replace(
        F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""
    )
    inner = lambda b: blank_to_null(F.regexp_extract(b, r"(?s)\{.*\}", 0))
    found = let(bare, lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(inner(b))))
    return let(found, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _node(v: Column, key: str) -> Column:
    """Value of a key; a {value, confidence} wrapper is opened."""
    return F.coalesce(
        F.try_variant_get(v, f"$.{key}.value", "variant"),
        F.try_variant_get(v, f"$.{key}", "variant"),
    )


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kind})"), F.lit(False))


def _scalar(v: Column) -> Column:
    """Text of a plain value; an object gives the text of its value, a list none."""
    return F.when(
        _is(v, "OBJECT"), F.try_variant_get(v, "$.value", "string")
    ).when(~_is(v, "ARRAY"), F.try_variant_get(v, "$", "string"))


def _opened(v: Column, tidy: Callable[[Column], Column], separators: str) -> Column:
    """An object as two lookups by key: ``t`` its texts and ``l`` its lists.

    All keys are read in one pass, so alias keys cost only a lookup each.
    """

    def strings(n: Column) -> Column:
        listed = F.filter(
            F.transform(_items(n), lambda x: tidy(_scalar(x))), lambda s: s.isNotNull()
        )
        split = F.when(_is(n, "STRING"), string_list(_scalar(n), separators))
        return F.filter(F.coalesce(listed, split), lambda s: s != "")

    def maps(m: Column) -> Column:
        plain = F.transform_values(
            m, lambda _, n: F.coalesce(F.try_variant_get(n, "$.value", "variant"), n)
        )
        return let(
            plain,
            lambda p: F.struct(
                F.transform_values(p, lambda _, n: tidy(_scalar(n))).alias("t"),
                F.transform_values(p, lambda _, n: strings(n)).alias("l"),
            ),
        )

    return maps(F.try_variant_get(v, "$", "map<string,variant>"))


def _text(o: Column, *keys: str) -> Column:
    """First filled value among alias keys."""
    return F.coalesce(*[F.try_element_at(o["t"], F.lit(k)) for k in keys])


def _strings(o: Column, *keys: str) -> Column:
    """First filled list among alias keys; separated text counts as a list."""
    found = F.filter(
        F.array(*[F.try_element_at(o["l"], F.lit(k)) for k in keys]), lambda x: F.size(x) > 0
    )
    return F.coalesce(F.get(found, F.lit(0)), str_array([]))


def _named(v: Column, *keys: str) -> Column:
    """Skill-like lists: strings, or objects with a name or skill."""

    def name(x: Column) -> Column:
        return F.coalesce(
            clean(_scalar(x)),
            clean(F.try_variant_get(x, "$.name", "string")),
            clean(F.try_variant_get(x, "$.skill", "string")),
        )

    lists = F.transform(
        F.array(*[_items(_node(v, k)) for k in keys]),
        lambda xs: F.filter(F.transform(xs, name), lambda s: s.isNotNull()),
    )
    found = F.filter(lists, lambda x: F.size(x) > 0)
    return F.coalesce(F.get(found, F.lit(0)), str_array([]))


def _flag(o: Column, *keys: str) -> Column:
    yes = str_array(["1", "true", "yes", "y", "present", "current"])
    words = F.array(*[F.lower(F.try_element_at(o["t"], F.lit(k))) for k in keys])
    return F.coalesce(F.arrays_overlap(yes, F.array_compact(words)), F.lit(False))


def _read_canonical(v: Column) -> Column:
    return _opened(v, clean, r"[,\n]")


def _read_extracted(v: Column) -> Column:
    return _opened(v, clean_or_null_word, r"[,;\n]")


def _objects(
    v: Column,
    key: str,
    build: Callable[[Column, Column, Column], Column],
    read: Callable[[Column], Column] = _read_canonical,
) -> Column:
    """Map the objects of a list; anything else in it is skipped."""
    rows = F.filter(_items(_node(v, key)), lambda x: _is(x, "OBJECT"))
    return F.transform(rows, lambda x, i: let(read(x), lambda o: build(o, x, i)))


def _ident(o: Column, prefix: str, i: Column) -> Column:
    number = F.lpad((i + 1).cast("string"), 2, "0")
    return F.coalesce(_text(o, "id"), F.concat(F.lit(f"{prefix}_"), number)).alias("id")


def _period(o: Column, current: Column, *end_keys: str) -> list[Column]:
    end = _text(o, *end_keys)
    now = current | F.coalesce(is_present(end), F.lit(False))
    return [F.when(~now, end).alias("end_date"), now.alias("is_current")]


def _facts(o: Column) -> Column:
    return _strings(o, "source_fact_ids").alias("source_fact_ids")


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _experience(o: Column, v: Column, i: Column) -> Column:
    return F.struct(
        _ident(o, "experience", i),
        _text(o, "company", "organization").alias("company"),
        _text(o, "title", "role", "job_title").alias("title"),
        _text(o, "location").alias("location"),
        _text(o, "start_date", "start").alias("start_date"),
        *_period(o, _flag(o, "is_current"), "end_date"),
        _text(o, "summary", "description").alias("summary"),
        _strings(o, "bullets", "achievements", "details").alias("bullets"),
        _facts(o),
    )


def _education(o: Column, v: Column, i: Column) -> Column:
    return F.struct(
        _ident(o, "education", i),
        _text(o, "institution", "school", "college", "university").alias("institution"),
        _text(o, "degree", "title").alias("degree"),
        _text(o, "specialization", "field", "major").alias("specialization"),
        _text(o, "location").alias("location"),
        _text(o, "start_date", "start").alias("start_date"),
        *_period(o, _flag(o, "is_current"), "end_date", "graduation_date", "year"),
        _text(o, "score", "gpa", "cgpa").alias("score"),
        _text(o, "score_type", "grade_scale").alias("score_type"),
        _text(o, "summary", "description").alias("summary"),
        _strings(o, "details").alias("details"),
        _facts(o),
    )


def _project(o: Column, v: Column, i: Column) -> Column:
    return F.struct(
        _ident(o, "project", i),
        _text(o, "title", "name").alias("title"),
        _text(o, "organization", "company").alias("organization"),
        _text(o, "url", "link").alias("url"),
        _text(o, "location").alias("location"),
        _text(o, "start_date", "start").alias("start_date"),
        *_period(o, _flag(o, "is_current"), "end_date"),
        _text(o, "summary", "description").alias("summary"),
        _strings(o, "bullets", "details").alias("bullets"),
        _named(v, "technologies", "tech", "skills").alias("technologies"),
        _facts(o),
    )


def _certification(o: Column, v: Column, i: Column) -> Column:
    return F.struct(
        _ident(o, "certification", i),
        _text(o, "title", "name").alias("title"),
        _text(o, "issuer", "organization", "authority").alias("issuer"),
        _text(o, "date", "issued_date", "start_date").alias("date"),
        _text(o, "expiry_date", "end_date").alias("expiry_date"),
        _text(o, "credential_id", "credentialId").alias("credential_id"),
        _text(o, "url", "link").alias("url"),
        _text(o, "summary", "description").alias("summary"),
        _facts(o),
    )


def _award(o: Column, v: Column, i: Column) -> Column:
    return F.struct(
        _ident(o, "award", i),
        _text(o, "title", "name").alias("title"),
        _text(o, "issuer", "organization").alias("issuer"),
        _text(o, "date", "year").alias("date"),
        _text(o, "summary", "description").alias("summary"),
        _facts(o),
    )


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def canonical(v: Column) -> Column:
    """Any resume object as content of the current schema.

    Known alias keys are read, missing parts become empty, an end of
    "Present" turns into a current entry, and a given schema version is kept.
    """
    return let(
        _read_canonical(v),
        lambda o: let(
            _read_canonical(F.try_variant_get(v, "$.contact", "variant")),
            lambda contact: let(
                _read_canonical(F.try_variant_get(v, "$.personal", "variant")),
                lambda personal: _canonical(v, o, contact, personal),
            ),
        ),
    )


def _canonical(v: Column, o: Column, contact: Column, personal: Column) -> Column:
    links, card = _strings(o, "links"), _strings(contact, "links")
    contact_links = F.when(F.size(card) > 0, card).otherwise(links)
    fields = {
        "schema_version": F.coalesce(_text(o, "schema_version"), F.lit(vocab.SCHEMA_VERSION)),
        "contact": _struct(
            {k: _text(contact, k) for k in ("name", "email", "phone", "location")}
            | {"links": contact_links}
        ),
        "headline": F.coalesce(_text(o, "headline"), _text(personal, "job_title")),
        "summary": _text(o, "summary"),
        "experience": _list(_objects(v, "experience", _experience), schemas.EXPERIENCE),
        "education": _list(_objects(v, "education", _education), schemas.EDUCATION),
        "skills": _named(v, "skills"),
        "projects": _list(_objects(v, "projects", _project), schemas.PROJECT),
        "certifications": _list(
            _objects(v, "certifications", _certification), schemas.CERTIFICATION
        ),
        "awards": _list(_objects(v, "awards", _award), schemas.AWARD),
        "languages": _named(v, "languages"),
        "hobbies": _named(v, "hobbies"),
        "personal": _struct(
            {
                "job_title": F.coalesce(_text(personal, "job_title"), _text(o, "headline")),
                "work_authorization": _text(personal, "work_authorization"),
                "notes": _text(personal, "notes"),
            }
        ),
        "links": F.when(F.size(links) > 0, links).otherwise(contact_links),
    }
    return _struct(fields).cast(schemas.RESUME_CONTENT)


def profile_content(
    data: Column, headline: Column, summary: Column, location: Column
) -> Column:
    """Profile content: a nested resume, else the object itself, else its flat columns."""
    nested = F.try_variant_get(data, "$.resume", "variant")
    has_nested = F.coalesce(F.schema_of_variant(nested).startswith("OBJECT"), F.lit(False))
    looks_like = F.coalesce(
        F.schema_of_variant(data).rlike(r"[<,] ?(contact|experience|skills|education|summary):"),
        F.lit(False),
    )
    seed = F.parse_json(
        F.to_json(
            F.struct(
                headline.alias("headline"),
                summary.alias("summary"),
                F.struct(location.alias("location")).alias("contact"),
                F.struct(headline.alias("job_title")).alias("personal"),
            )
        )
    )
    return canonical(F.when(has_nested, nested).when(looks_like, data).otherwise(seed))


def _first_of_each(items: Column, *keys: str) -> Column:
    """Drop later items with the same values; items with no values at all stay."""

    def signature(x: Column) -> Column:
        return F.concat_ws(
            "\u0001", *[F.lower(F.coalesce(x[k], F.lit(""))) for k in keys]
        )

    empty = "\u0001" * (len(keys) - 1)
    return let(
        items,
        lambda xs: let(
            F.transform(xs, signature),
            lambda seen: F.filter(
                xs,
                lambda x, i: (signature(x) == empty)
                | (F.array_position(seen, signature(x)) == i + 1),
            ),
        ),
    )


def _few_words(limit: int) -> Callable[[Column], Column]:
    return lambda s: word_count(s).between(1, limit)


def _repaired_skills(v: Column, o: Column, languages: Column) -> Column:
    groups = F.try_variant_get(_node(v, "skill_groups"), "$", "map<string,variant>")
    grouped = F.flatten(
        F.transform(
            F.map_values(groups),
            lambda g: F.coalesce(
                F.transform(_items(g), lambda x: clean(_scalar(x))),
                string_list(_scalar(g)),
            ),
        )
    )
    listed = F.concat(
        _strings(o, "skills"), F.coalesce(grouped, str_array([]))
    )
    kept = F.filter(listed, lambda s: _few_words(5)(s) & ~s.rlike(_ONLY_LEAK))
    moved = F.filter(languages, lambda s: s.rlike(_PROGRAMMING))
    return F.array_distinct(F.concat(kept, moved))


def _repaired_languages(languages: Column) -> Column:
    return F.filter(
        languages,
        lambda s: _few_words(3)(s)
        & ~s.rlike(_PROGRAMMING)
        & (F.lower(s).isin(vocab.SPOKEN_LANGUAGES) | _few_words(2)(s)),
    )


def _repaired_experience(v: Column) -> Column:
    def build(o: Column, x: Column, i: Column) -> Column:
        return F.struct(
            _ident(o, "experience", i),
            _text(o, "company").alias("company"),
            _text(o, "job_title", "title").alias("title"),
            _text(o, "location").alias("location"),
            _text(o, "start_date").alias("start_date"),
            *_period(o, _flag(o, "currently_working", "is_current"), "end_date"),
            _text(o, "summary").alias("summary"),
            F.filter(
                _strings(o, "achievements", "bullets"),
                lambda a: ~a.rlike(_ONLY_LEAK),
            ).alias("bullets"),
            _facts(o),
        )

    def keep(e: Column) -> Column:
        title, company = F.coalesce(e["title"], F.lit("")), F.coalesce(e["company"], F.lit(""))
        leaked = title.rlike(_BULLET_MARK) | title.rlike(_LEAK)
        for pattern in (_BULLET_MARK, _VERB, _LEAK):
            leaked = leaked | company.rlike(pattern)
        return ((title != "") | (company != "")) & ~leaked

    rows = F.filter(_objects(v, "experience", build, _read_extracted), keep)
    return _first_of_each(rows, "title", "company", "start_date")


def _repaired_projects(v: Column) -> Column:
    def build(o: Column, x: Column, i: Column) -> Column:
        title = _text(o, "title", "name")
        dated = F.coalesce(title.rlike(_TITLE_DATES), F.lit(False))
        title_end = F.regexp_extract(title, _TITLE_DATES, 2)
        end = _text(o, "end_date")
        now = _flag(o, "currently_working", "is_current") | (dated & is_present(title_end))
        now = now | F.coalesce(is_present(end), F.lit(False))
        bare = F.regexp_replace(
            F.regexp_replace(title, _TITLE_DATES, ""), r"^[ |·•\-–—]+|[ |·•\-–—]+$", ""
        )
        return F.struct(
            _ident(o, "project", i),
            F.when(dated, bare).otherwise(title).alias("title"),
            _text(o, "organization", "company").alias("organization"),
            _text(o, "url", "link").alias("url"),
            _text(o, "location").alias("location"),
            F.coalesce(
                _text(o, "start_date"), F.when(dated, F.regexp_extract(title, _TITLE_DATES, 1))
            ).alias("start_date"),
            F.when(~now, F.coalesce(end, F.when(dated, title_end))).alias("end_date"),
            now.alias("is_current"),
            _text(o, "summary").alias("summary"),
            _strings(o, "highlights", "bullets").alias("bullets"),
            F.filter(_strings(o, "technologies"), _few_words(5)).alias(
                "technologies"
            ),
            _facts(o),
        )

    rows = F.filter(
        _objects(v, "projects", build, _read_extracted),
        lambda p: p["title"].isNotNull()
        & ~p["title"].rlike(_NOT_A_PROJECT)
        & ~p["title"].rlike(_BULLET_MARK)
        & ~p["title"].rlike(_ONLY_LEAK),
    )
    return _first_of_each(rows, "title", "organization", "start_date")


def _repaired_education(v: Column) -> Column:
    def build(o: Column, x: Column, i: Column) -> Column:
        kind = (
            F.when(_text(o, "cgpa").isNotNull(), "cgpa")
            .when(_text(o, "gpa").isNotNull(), "gpa")
            .when(_text(o, "grade").isNotNull(), "other")
        )
        return F.struct(
            _ident(o, "education", i),
            _text(o, "institution", "school").alias("institution"),
            _text(o, "degree").alias("degree"),
            _text(o, "specialization", "major").alias("specialization"),
            _text(o, "location").alias("location"),
            _text(o, "start_date").alias("start_date"),
            *_period(o, _flag(o, "currently_studying", "is_current"), "end_date"),
            _text(o, "cgpa", "gpa", "grade", "score").alias("score"),
            kind.alias("score_type"),
            _text(o, "summary").alias("summary"),
            str_array([]).alias("details"),
            _facts(o),
        )

    rows = F.filter(
        _objects(v, "education", build, _read_extracted),
        lambda e: (e["institution"].isNotNull() | e["degree"].isNotNull())
        & ~F.coalesce(e["institution"].rlike(_BULLET_MARK), F.lit(False)),
    )
    return _first_of_each(rows, "institution", "degree", "end_date")


def _repaired_certifications(v: Column) -> Column:
    def build(o: Column, x: Column, i: Column) -> Column:
        return F.struct(
            _ident(o, "certification", i),
            _text(o, "name", "title").alias("title"),
            _text(o, "issuer").alias("issuer"),
            _text(o, "issue_date", "date").alias("date"),
            _text(o, "expiry_date").alias("expiry_date"),
            _text(o, "credential_id").alias("credential_id"),
            _text(o, "credential_url", "url").alias("url"),
            _text(o, "summary").alias("summary"),
            _facts(o),
        )

    rows = F.filter(
        _objects(v, "certifications", build, _read_extracted),
        lambda c: c["title"].isNotNull() & ~c["title"].rlike(_NOT_A_CERTIFICATE),
    )
    return _first_of_each(rows, "title", "issuer", "date")


def _repaired_awards(v: Column) -> Column:
    def build(o: Column, x: Column, i: Column) -> Column:
        return F.struct(
            _ident(o, "award", i),
            _text(o, "title", "name").alias("title"),
            _text(o, "issuer").alias("issuer"),
            _text(o, "date").alias("date"),
            _text(o, "summary").alias("summary"),
            _facts(o),
        )

    rows = F.filter(_objects(v, "awards", build, _read_extracted), lambda a: a["title"].isNotNull())
    return _first_of_each(rows, "title", "issuer", "date")


def repaired_summary(summary: Column) -> Column:
    """Cut a heading that leaked in at the end; reduce a dumped list to one sentence."""
    cut = strip(F.regexp_replace(summary, _LEAKED_HEADING, ""))
    commas = F.length(cut) - F.length(F.replace(cut, F.lit(","), F.lit("")))
    dumped = (word_count(cut) > 120) & (commas > 12)
    return blank_to_null(F.when(dumped, strip(F.split(cut, r"\.")[0])).otherwise(cut))


def repaired_location(location: Column, skills: Column) -> Column:
    """Drop a location that is really a sentence or a list of skills."""
    words = word_count(location)
    listed = (
        location.contains(",")
        & F.exists(skills, lambda s: F.lower(location).contains(F.lower(s)))
        & (words > 8)
    )
    return F.when(~((location.rlike(_VERB) | listed) & (words > 6)), location)


def repair(v: Column) -> Column:
    """Extractor payload to canonical content: unwrap, reject leaks, dedupe, map."""
    return let(v, lambda x: let(_read_extracted(x), lambda o: _repaired(x, o)))


def _repaired(v: Column, o: Column) -> Column:
    languages = _strings(o, "languages")
    skills = _repaired_skills(v, o, languages)
    links = F.array_distinct(
        F.array_compact(
            F.array(*[_text(o, k) for k in ("linkedin", "github", "portfolio", "website")])
        )
    )
    null = F.lit(None).cast("string")
    headline = _text(o, "headline")
    fields = {
        "schema_version": F.lit(vocab.SCHEMA_VERSION),
        "contact": _struct(
            {
                "name": _text(o, "full_name", "name"),
                "email": _text(o, "email"),
                "phone": _text(o, "phone"),
                "location": repaired_location(_text(o, "location"), skills),
                "links": links,
            }
        ),
        "headline": headline,
        "summary": repaired_summary(_text(o, "summary")),
        "experience": _list(_repaired_experience(v), schemas.EXPERIENCE),
        "education": _list(_repaired_education(v), schemas.EDUCATION),
        "skills": skills,
        "projects": _list(_repaired_projects(v), schemas.PROJECT),
        "certifications": _list(_repaired_certifications(v), schemas.CERTIFICATION),
        "awards": _list(_repaired_awards(v), schemas.AWARD),
        "languages": _repaired_languages(languages),
        "hobbies": str_array([]),
        "personal": _struct(
            {"job_title": headline, "work_authorization": null, "notes": null}
        ),
        "links": links,
    }
    return _struct(fields).cast(schemas.RESUME_CONTENT)


def repair_payloads(payloads: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Repaired contents, and the payloads that hold no JSON object."""
    # A row of its own list: Spark would put a filter on a plain column below it and parse each body twice.
    parsed = payloads.select("*", F.explode(F.array(parse_object(F.col(body)))).alias("_v"))
    good = parsed.filter(F.col("_v").isNotNull()).select(key, repair(F.col("_v")).alias("content"))
    bad = parsed.filter(F.col("_v").isNull()).select(key, F.lit("invalid_json").alias("reason"))
    return good, bad


def _filled(c: Column) -> Column:
    return blank_to_null(c).isNotNull()


def confidence(content: Column) -> Column:
    """Sum of the weights of the parts that are filled."""
    present = {
        "name": _filled(content["contact"]["name"]),
        "email": _filled(content["contact"]["email"]),
        "headline": _filled(content["headline"]),
        "summary": _filled(content["summary"]),
    } | {
        part: F.size(content[part]) > 0
        for part in ("experience", "education", "skills", "projects", "certifications")
    }
    total = F.lit(0.0)
    for part, weight in vocab.CONFIDENCE_WEIGHTS.items():
        total = total + F.when(present[part], weight).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 2)


def needs_review(content: Column) -> Column:
    some = _filled(content["headline"]) | _filled(content["summary"])
    for part in ("experience", "skills", "projects", "education"):
        some = some | (F.size(content[part]) > 0)
    return (confidence(content) < vocab.REVIEW_BELOW) | ~some


def validated(contents: DataFrame) -> DataFrame:
    """Add confidence, review flag and checksum beside the content."""
    content = F.col("content")
    return (
        contents.withColumn("confidence", confidence(content))
        .withColumn("needs_review", needs_review(content))
        .withColumn("content_checksum", checksum("content"))
    )


def merged(primary: Column, fallback: Column) -> Column:
    """Part by part: the primary content where it is filled, else the fallback."""
    out = primary
    for part in (
        "experience", "education", "projects", "certifications", "awards", "skills",
        "languages", "hobbies",
    ):
        out = out.withField(
            part, F.when(F.size(primary[part]) > 0, primary[part]).otherwise(fallback[part])
        )
    for part in ("summary", "headline"):
        out = out.withField(part, F.coalesce(blank_to_null(primary[part]), fallback[part]))
    mine, other = primary["contact"], fallback["contact"]
    card = mine
    for part in ("name", "email", "phone", "location"):
        card = card.withField(part, F.coalesce(blank_to_null(mine[part]), other[part]))
    card = card.withField(
        "links", F.when(F.size(mine["links"]) > 0, mine["links"]).otherwise(other["links"])
    )
    return out.withField("contact", card)


def merge_contents(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    other = fallback.select(key, F.col("content").alias("_fallback"))
    return primary.join(other, key, "left").select(
        key,
        F.when(F.col("_fallback").isNull(), F.col("content"))
        .otherwise(merged(F.col("content"), F.col("_fallback")))
        .alias("content"),
    )
