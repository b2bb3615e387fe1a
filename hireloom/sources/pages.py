"""Job pages mapped to observations by an ordered cascade of extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions.classify import remote_type_from_text
from hireloom.functions.html import first_text, job_id, job_url, strip_html
from hireloom.functions.skills import display_skill, inferred_skills
from hireloom.functions.text import blank_to_null, clean, let, strip
from hireloom.sources.providers import to_observations

# Markup patterns of a job page, tried in this order.
TITLE_PATTERNS = [
    r'class="[^"]*top-card-layout__title[^"]*"[^>]*>(.*?)</h2>',
    r'class="[^"]*topcard__title[^"]*"[^>]*>(.*?)</h2>',
    r"<h1[^>]*>(.*?)</h1>",
    r"<title>\s*(?:[^|<]+hiring\s+)?([^|<]+?)\s+in\s+[^|<]+\|\s*LinkedIn\s*</title>",
]
COMPANY_PATTERNS = [
    r'class="[^"]*topcard__org-name-link[^"]*"[^>]*>(.*?)</a>',
    r'class="[^"]*topcard__flavor--black-link[^"]*"[^>]*>(.*?)</a>',
    r'<a[^>]*data-tracking-control-name="public_jobs_topcard-org-name"[^>]*>(.*?)</a>',
    r"<title>\s*([^|<]+?)\s+hiring\s+",
]
LOCATION_PATTERNS = [
    r'class="[^"]*topcard__flavor--bullet[^"]*"[^>]*>(.*?)</span>',
    r'class="[^"]*topcard__flavor[^"]*"[^>]*>\s*([^<]+?)\s*</span>',
]
DESCRIPTION_PATTERNS = [
    r'class="[^"]*show-more-less-html__markup[^"]*"[^>]*>(.*?)</div>',
    r'class="[^"]*description__text[^"]*"[^>]*>(.*?)</div>',
    r'class="[^"]*core-section-container__content[^"]*"[^>]*>(.*?)</div>\s*</div>',
]
LD_BLOCK = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
OG_TITLE = r'property="og:title"\s+content="([^"]+)"'
OG_DESCRIPTION = r'property="og:description"\s+content="([^"]+)"'
HIRING = r"(?i)^(.+?)\s+hiring\s+(.+?)\s+in\s+(.+?)(?:\s*\|\s*LinkedIn)?$"
SHORT_DESCRIPTION = 200


def _page(
    title: Column, company: Column, description: Column, location: Column, found_by: str
) -> Column:
    """One candidate reading of a page; null when the extractor found nothing."""
    return F.struct(
        title.alias("title"),
        company.alias("company"),
        description.alias("description"),
        location.alias("location"),
        F.lit(found_by).alias("found_by"),
    )


def from_markup(html: Column) -> Column:
    def read(found: Column) -> Column:
        page = _page(
            F.coalesce(found["title"], F.lit(vocab.PAGE_UNTITLED)),
            F.coalesce(found["company"], F.lit(vocab.UNKNOWN_COMPANY)),
            found["description"],
            found["location"],
            "html",
        )
        return F.when(found["title"].isNotNull() | found["description"].isNotNull(), page)

    found = _page(
        first_text(html, TITLE_PATTERNS),
        first_text(html, COMPANY_PATTERNS),
        first_text(html, DESCRIPTION_PATTERNS),
        first_text(html, LOCATION_PATTERNS),
        "html",
    )
    return let(found, read)


def _text(v: Column, path: str) -> Column:
    return blank_to_null(F.try_variant_get(v, path, "string"))


def from_json_ld(html: Column) -> Column:
    """First JobPosting object of the page, in page order."""
    blocks = F.transform(
        F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1)),
        lambda raw: F.try_parse_json(strip(raw)),
    )
    objects = F.flatten(
        F.transform(
            blocks,
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )
    )

    def is_posting(v: Column) -> Column:
        names = F.coalesce(
            F.try_variant_get(v, "$['@type']", "array<string>"),
            F.array(F.try_variant_get(v, "$['@type']", "string")),
        )
        return F.coalesce(F.array_contains(names, "JobPosting"), F.lit(False))

    def read(v: Column) -> Column:
        address = [
            _text(v, f"$.jobLocation.address.{k}")
            for k in ("addressLocality", "addressRegion", "addressCountry")
        ]
        place = F.try_variant_get(v, "$.jobLocation", "array<variant>")
        return _page(
            strip(F.coalesce(_text(v, "$.title"), F.lit(vocab.PAGE_UNTITLED))),
            F.coalesce(_text(v, "$.hiringOrganization.name"), F.lit(vocab.UNKNOWN_COMPANY)),
            strip_html(_text(v, "$.description")),
            F.when(
                place.isNotNull(),
                F.try_variant_get(v, "$.jobLocation[0].address.addressLocality", "string"),
            ).otherwise(blank_to_null(F.concat_ws(", ", *address))),
            "json_ld",
        )

    postings = F.filter(objects, lambda v: v.isNotNull() & is_posting(v))
    return F.get(F.transform(F.slice(postings, 1, 1), read), F.lit(0))


def from_og(html: Column) -> Column:
    """Open-Graph title and description; "X hiring Y in Z" is split in three."""

    def read(title: Column) -> Column:
        def part(group: int) -> Column:
            return blank_to_null(strip(F.regexp_extract(title, HIRING, group)))

        page = _page(
            F.coalesce(part(2), strip(title)),
            F.coalesce(part(1), F.lit(vocab.UNKNOWN_COMPANY)),
            first_text(html, [OG_DESCRIPTION]),
            part(3),
            "og_meta",
        )
        return F.when(title.isNotNull(), page)

    return let(first_text(html, [OG_TITLE]), read)


def _first(v: Column, *paths: str) -> Column:
    """First filled text among paths; an object counts only through its inner fields."""
    return F.coalesce(*[_plain(v, p) for p in paths])


def _plain(v: Column, path: str) -> Column:
    return blank_to_null(
        let(
            F.try_variant_get(v, path, "variant"),
            lambda n: F.when(
                ~F.coalesce(F.schema_of_variant(n).rlike("^(OBJECT|ARRAY)"), F.lit(False)),
                F.try_variant_get(n, "$", "string"),
            ),
        )
    )


# Keys of the JSON answer, outer then inner, in order of preference.
JSON_TITLE = (("title", "normalizedTitle"), ("text", "name"))
JSON_COMPANY = (("companyDetails", "company"), ("companyName", "name", "universalName"))
JSON_DESCRIPTION = (("description", "jobDescription"), ("text", "html"))
JSON_LOCATION = (("formattedLocation", "location"), ("default", "name"))


def from_json_payload(body: Column) -> Column:
    """A JSON answer whose values may be plain strings or nested objects."""

    def nested(keys: tuple[str, ...], inner: tuple[str, ...]) -> list[str]:
        return [p for k in keys for p in (*[f"$.{k}.{i}" for i in inner], f"$.{k}")]

    def read(v: Column) -> Column:
        title = _first(v, *nested(*JSON_TITLE))
        company = _first(v, *nested(*JSON_COMPANY))
        page = _page(
            F.coalesce(strip(title), F.lit(vocab.PAGE_UNTITLED)),
            F.coalesce(clean(company), F.lit(vocab.UNKNOWN_COMPANY)),
            strip_html(_first(v, *nested(*JSON_DESCRIPTION))),
            _first(v, *nested(*JSON_LOCATION)),
            "json",
        )
        return F.when(F.coalesce(F.schema_of_variant(v).rlike("^OBJECT<."), F.lit(False)), page)

    return let(F.try_parse_json(body), read)


def from_pasted(description: Column, title_length: int | None = None) -> Column:
    """Description-only record, titled by its first non-blank line."""
    text = strip(description)
    first_line = F.get(
        F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda s: s != ""), F.lit(0)
    )
    title = first_line if title_length is None else F.substring(first_line, 1, title_length)
    page = _page(
        F.coalesce(title, F.lit(vocab.PAGE_UNTITLED)),
        F.lit(vocab.PASTED_COMPANY),
        text,
        F.lit(None).cast("string"),
        "pasted",
    )
    return F.when(blank_to_null(text).isNotNull(), page)


def _with_override(page: Column, override: Column, always: bool) -> Column:
    """Put a pasted description in place of a missing or short one."""
    weak = page["description"].isNull() | (F.length(page["description"]) < SHORT_DESCRIPTION)
    use = (F.coalesce(override, F.lit("")) != "") & (F.lit(True) if always else weak)
    return F.when(
        page.isNotNull(),
        page.withField(
            "description", F.when(use, strip(override)).otherwise(page["description"])
        ),
    )


def _useful(page: Column) -> Column:
    """A page with a description or a real title; else the next extractor is tried."""
    filled = F.coalesce(page["description"], F.lit("")) != ""
    return F.when(filled | (page["title"] != vocab.PAGE_UNTITLED), page)


def read_pages(pages: DataFrame, override: str | None = None) -> DataFrame:
    """Add ``page``: JSON answer, markup, JSON-LD, Open Graph, then pasted text.

    ``override`` names a column with a pasted description.
    """
    html = F.col("html")
    pasted = F.col(override) if override else F.lit(None).cast("string")

    def attempt(page: Column) -> Column:
        return let(page, lambda p: let(_with_override(p, pasted, always=False), _useful))

    answer = let(
        F.when(F.ltrim(html).startswith("{"), from_json_payload(html)),
        lambda p: _with_override(p, pasted, always=True),
    )
    page = F.coalesce(
        answer,
        attempt(from_markup(html)),
        attempt(from_json_ld(html)),
        attempt(from_og(html)),
        from_pasted(pasted),
    )
    # A row of its own list: Spark would put a filter on a plain column below it and read each page twice.
    return pages.select("*", F.explode(F.array(page)).alias("page"))


def postings_from_pages(
    pages: DataFrame, override: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Observations, and the pages rejected for a bad URL or unusable content."""
    read = read_pages(pages, override).withColumn("job_id", job_id(F.col("url")))
    ok = F.col("job_id").isNotNull() & F.col("page").isNotNull()
    page = F.col("page")
    skills = F.transform(
        inferred_skills(
            F.concat_ws("\n", page["title"], F.coalesce(page["description"], F.lit("")))
        ),
        display_skill,
    )
    observations = to_observations(
        read.filter(ok),
        provider=F.lit(vocab.PAGE_PROVIDER),
        external_id=F.col("job_id"),
        title=page["title"],
        company_name=page["company"],
        description=page["description"],
        location=page["location"],
        remote_type=remote_type_from_text(page["location"], page["description"]),
        canonical_url=job_url(F.col("url")),
        source_url=F.col("url"),
        requirements=F.struct(
            skills.alias("skills"),
            F.lit(None).cast("string").alias("job_type"),
            F.lit(None).cast("string").alias("category"),
            F.lit(None).cast("int").alias("match_score"),
            F.lit(None).cast("string").alias("source"),
        ),
        raw_payload=F.to_json(
            F.struct(page["found_by"].alias("source"), F.col("job_id").alias("job_id"))
        ),
    )
    rejects = read.filter(~ok).select(
        "page_id",
        "url",
        F.when(F.col("job_id").isNull(), "invalid_url")
        .otherwise("fetch_failed")
        .alias("reason"),
    )
    return observations, rejects
