"""Section lines to records: roles, education, skills, contact, whole resumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hireloom import schemas, vocab
from hireloom.functions import contact
from hireloom.functions.dates import date_range, has_date, has_range, is_present
from hireloom.functions.text import blank_to_null, let, str_array, strip, word_count
from hireloom.operators.sections import (
    heading_rest,
    islands,
    normal_text,
    section_name,
    section_text_lines,
    segments,
)

BULLET = vocab.BULLET_PATTERN

# Labels of skill groups that look like a role header, and how a degree line starts.
SKILL_LABEL = r"^(data engineering|cloud|ai:)"
DEGREE_START = r"^\p{Lu}|^(?i:master|bachelor|bca|mca)"


def _trim(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def _is_new_line(line: Column) -> Column:
    dated, piped = has_range(line), line.contains("|")
    short = (
        (word_count(line) <= 12) & ~line.endswith(",") & ~line.rlike(r"^\p{Ll}")
    )
    return (
        is_bullet(line)
        | section_name(line).isNotNull()
        | line.rlike(r"^[A-Za-z][A-Za-z0-9 &/+\-]{1,40}:\s*\S")
        | (line.rlike(r".+\|.+") & (dated | has_date(line)))
        | (dated & piped)
        | (short & (dated | piped))
    )


def reflow(lines: Column) -> Column:
    """Join wrapped lines; no blank follows a line that ends in a hyphen."""
    kept = F.filter(lines, lambda x: section_name(x).isNull() | (heading_rest(x) != ""))

    def join(run: Column) -> Column:
        glued = F.transform(
            run, lambda x: F.when(x.endswith("-"), x).otherwise(F.concat(x, F.lit(" ")))
        )
        return F.rtrim(F.array_join(glued, ""))

    return F.transform(islands(kept, _is_new_line), join)


def is_role_header(line: Column) -> Column:
    piped = line.contains("|")
    labelled = F.lower(line).rlike(SKILL_LABEL)
    return ~is_bullet(line) & (
        (has_range(line) & (piped | (word_count(line) <= 16))) | (piped & ~labelled)
    )


def _place_split(right: Column) -> Column:
    """"Company, City" into both parts when the last part is short."""

    def read(text: Column, parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        split = text.contains(",") & (F.size(parts) >= 2) & (word_count(last) <= 4)
        return let(
            split,
            lambda cut: F.struct(
                blank_to_null(
                    F.when(cut, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ", ")).otherwise(text)
                ).alias("name"),
                F.when(cut, last).alias("location"),
            ),
        )

    def split_at_commas(text: Column) -> Column:
        return let(F.filter(F.transform(F.split(text, ","), strip), lambda p: p != ""), lambda parts: read(text, parts))

    return let(right, split_at_commas)


def role_header(line: Column) -> Column:
    """title, company, location, start, end and is_current of an entry header."""

    def parse(d: Column) -> Column:
        rest = d["rest"]
        left = _trim(F.regexp_extract(rest, r"^([^|]*)\|", 1), r" |\-–—")
        right = _trim(F.regexp_extract(rest, r"^[^|]*\|(.*)$", 1), r" |\-–—")
        piped = rest.contains("|")
        at = F.lower(rest).contains(" at ") & ~piped
        title = (
            F.when(piped, left)
            .when(at, F.regexp_extract(rest, r"(?i)^(.*?)\s+at\s+", 1))
            .otherwise(rest)
        )
        behind = F.when(at, blank_to_null(strip(F.regexp_replace(rest, r"(?i)^.*?\s+at\s+", ""))))
        return let(
            F.when(piped, _place_split(right)),
            lambda place: F.struct(
                blank_to_null(strip(title)).alias("title"),
                F.when(piped, place["name"]).otherwise(behind).alias("company"),
                place["location"].alias("location"),
                d["start"].alias("start"),
                d["end"].alias("end"),
                d["is_current"].alias("is_current"),
            ),
        )

    return let(date_range(strip(line)), parse)


def bullets(lines: Column) -> Column:
    """Bullet texts: unmarked lines continue a bullet, stray fragments join the last."""
    rows = F.filter(
        F.transform(
            lines,
            lambda x: F.struct(
                is_bullet(x).alias("marked"),
                strip(F.regexp_replace(x, BULLET, "")).alias("text"),
            ),
        ),
        lambda r: r["text"] != "",
    )
    whole = F.transform(
        islands(rows, lambda r: r["marked"]),
        lambda run: strip(F.array_join(F.transform(run, lambda r: r["text"]), " ")),
    )
    long_enough = F.filter(whole, lambda t: F.length(t) > 2)
    glued = islands(long_enough, lambda t: ~t.rlike(r"^[a-z]{1,11}$"), keep_head=False)
    return F.transform(glued, lambda run: F.array_join(run, " "))


def _no_strings() -> Column:
    return str_array([])


def _numbered_id(prefix: str, index: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.lpad((index + 1).cast("string"), 2, "0"))


def _blocks(lines: Column) -> Column:
    """Entries of a section as (number, header fields, body lines)."""

    def read(block: Column, i: Column) -> Column:
        second = F.get(block, F.lit(1))
        return let(
            role_header(block[0]),
            lambda h: F.struct(
                i.cast("int").alias("i"),
                h.alias("h"),
                block.alias("block"),
                (
                    h["company"].isNull()
                    & second.isNotNull()
                    & ~is_bullet(second)
                    & ~(has_range(second) & second.contains("|"))
                ).alias("company_below"),
            ),
        )

    return F.transform(islands(reflow(lines), is_role_header), read)


def experience(lines: Column) -> Column:
    def build(e: Column) -> Column:
        h, below = e["h"], e["company_below"]
        second = F.get(e["block"], F.lit(1))
        late = date_range(F.coalesce(second, F.lit("")))
        current = h["is_current"] | (below & late["is_current"])
        skip = F.when(below, 3).otherwise(2)
        return F.struct(
            _numbered_id("experience", e["i"]).alias("id"),
            F.when(below, second).otherwise(h["company"]).alias("company"),
            h["title"].alias("title"),
            h["location"].alias("location"),
            F.coalesce(h["start"], F.when(below, late["start"])).alias("start_date"),
            F.when(~current, F.coalesce(h["end"], F.when(below, late["end"]))).alias("end_date"),
            current.alias("is_current"),
            F.lit(None).cast("string").alias("summary"),
            bullets(F.slice(e["block"], skip, F.size(e["block"]))).alias("bullets"),
            _no_strings().alias("source_fact_ids"),
        )

    return F.filter(
        F.transform(_blocks(lines), build),
        lambda e: e["title"].isNotNull() | e["company"].isNotNull() | (F.size(e["bullets"]) > 0),
    )


def projects(lines: Column) -> Column:
    def build(e: Column) -> Column:
        h = e["h"]
        null = F.lit(None).cast("string")
        return F.struct(
            _numbered_id("project", e["i"]).alias("id"),
            h["title"].alias("title"),
            h["company"].alias("organization"),
            null.alias("url"),
            null.alias("location"),
            h["start"].alias("start_date"),
            h["end"].alias("end_date"),
            h["is_current"].alias("is_current"),
            null.alias("summary"),
            bullets(F.slice(e["block"], 2, F.size(e["block"]))).alias("bullets"),
            _no_strings().alias("technologies"),
            _no_strings().alias("source_fact_ids"),
        )

    return F.filter(
        F.transform(_blocks(lines), build),
        lambda e: e["title"].isNotNull() | (F.size(e["bullets"]) > 0),
    )


def _degree_lines(line: Column) -> Column:
    """Split a line that holds several degrees."""
    parts = F.filter(
        F.transform(
            F.split(line, rf"(?i)(?=(?:{vocab.DEGREE_WORDS})\b)"), lambda p: _trim(p, " |")
        ),
        lambda p: p != "",
    )
    by_grade = F.filter(
        F.transform(F.split(line, r"(?<=\bCGPA)\s+(?=[A-Z])"), lambda p: _trim(p, " |")),
        lambda p: p != "",
    )
    usable = F.get(parts, F.lit(0)).rlike(DEGREE_START)
    return (
        F.when((F.size(parts) > 1) & usable, parts)
        .when(F.size(parts) > 1, F.array(line))
        .when(F.size(by_grade) > 1, by_grade)
        .otherwise(F.array(line))
    )


def _education_entry(line: Column, i: Column) -> Column:
    grade = rf"(?i){vocab.GRADE_PATTERN}"
    date = rf"(?iU)\b({vocab.DATE_TOKEN}|{vocab.PRESENT})\b"
    graded = line.rlike(grade)
    score = F.coalesce(
        blank_to_null(F.regexp_extract(line, grade, 1)),
        blank_to_null(F.regexp_extract(line, grade, 2)),
    )
    kind = F.when(F.lower(F.regexp_extract(line, grade, 0)).contains("cgpa"), "cgpa").otherwise("gpa")
    bare = F.when(graded, _trim(F.regexp_replace(line, grade, ""), " |")).otherwise(line)

    def dated(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(date), F.lit(1))
        end = F.try_element_at(found, F.lit(-1))
        at = F.length(F.call_function("substring_index", text, end, F.lit(-1)))
        cut = F.concat(
            F.substring(text, F.lit(1), F.length(text) - at - F.length(end)), F.right(text, at)
        )
        rest = F.when(end.isNotNull(), _trim(cut, " |")).otherwise(text)
        return F.struct(end.alias("end"), rest.alias("rest"))

    def build(d: Column) -> Column:
        rest = d["rest"]
        piped = rest.contains("|")
        place = _place_split(_trim(F.regexp_extract(rest, r"^[^|]*\|(.*)$", 1), " |"))
        degree = F.when(piped, _trim(F.regexp_extract(rest, r"^([^|]*)\|", 1), " |")).otherwise(rest)
        null = F.lit(None).cast("string")
        return F.struct(
            _numbered_id("education", i).alias("id"),
            F.when(piped, place["name"]).alias("institution"),
            blank_to_null(degree).alias("degree"),
            null.alias("specialization"),
            F.when(piped, place["location"]).alias("location"),
            null.alias("start_date"),
            F.when(~F.coalesce(is_present(d["end"]), F.lit(False)), d["end"]).alias("end_date"),
            F.coalesce(is_present(d["end"]), F.lit(False)).alias("is_current"),
            F.when(graded, score).alias("score"),
            F.when(graded, kind).alias("score_type"),
            null.alias("summary"),
            _no_strings().alias("details"),
            _no_strings().alias("source_fact_ids"),
        )

    return let(bare, lambda text: let(dated(text), build))


def education(lines: Column) -> Column:
    rows = F.flatten(F.transform(reflow(lines), _degree_lines))
    return F.filter(
        F.transform(rows, _education_entry),
        lambda e: e["degree"].isNotNull() | e["institution"].isNotNull(),
    )


def skill_items(text: Column) -> Column:
    """Items of a skill line; a slash does not split, so CI/CD stays whole."""
    items = F.transform(F.split(text, r"[,|•;]"), lambda p: _trim(p, r" \-•*"))
    return F.array_distinct(
        F.filter(
            items,
            lambda s: (s != "")
            & ~F.lower(s).isin("and", "or")
            & section_name(s).isNull()
            & (F.length(s) <= 60)
            & (word_count(s) <= 6),
        )
    )


def skills(lines: Column) -> Column:
    """Distinct skills in reading order; group labels are dropped."""
    chunks = F.flatten(
        F.transform(
            reflow(lines),
            lambda x: F.split(x, rf"(?iU)(?=\b(?:{vocab.SKILL_GROUP_LABELS})\s*:)"),
        )
    )
    return F.array_distinct(
        F.flatten(
            F.transform(chunks, lambda c: skill_items(F.regexp_replace(c, r"(?s)^[^:]*:", "")))
        )
    )


def certifications(lines: Column) -> Column:
    parts = F.split(F.array_join(reflow(lines), " | "), r"[|•]")
    null = F.lit(None).cast("string")
    rows = F.transform(
        parts,
        lambda p, i: F.struct(
            _numbered_id("certification", i).alias("id"),
            _trim(p, r" \-•*").alias("title"),
            *[
                null.alias(n)
                for n in ("issuer", "date", "expiry_date", "credential_id", "url", "summary")
            ],
            _no_strings().alias("source_fact_ids"),
        ),
    )
    return F.filter(
        rows, lambda c: (F.length(c["title"]) >= 3) & section_name(c["title"]).isNull()
    )


def awards(lines: Column) -> Column:
    null = F.lit(None).cast("string")
    rows = F.transform(
        reflow(lines),
        lambda x, i: F.struct(
            _numbered_id("award", i).alias("id"),
            strip(F.regexp_replace(x, BULLET, "")).alias("title"),
            *[null.alias(n) for n in ("issuer", "date", "summary")],
            _no_strings().alias("source_fact_ids"),
        ),
    )
    return F.filter(rows, lambda a: a["title"] != "")


def _is_contact(line: Column) -> Column:
    return line.rlike(contact.CONTACT_LINE)


def _until_heading(lines: Column, first: int) -> Column:
    """The first lines of the header, up to a section heading."""

    def cut(xs: Column) -> Column:
        stops = F.array_compact(
            F.transform(xs, lambda x, i: F.when(section_name(x).isNotNull(), i.cast("int")))
        )
        return F.slice(xs, 1, F.coalesce(F.get(stops, F.lit(0)), F.size(xs)))

    return let(F.slice(lines, 1, first), cut)


def person_name(header: Column) -> Column:
    return F.get(
        F.filter(
            _until_heading(header, 5),
            lambda x: ~_is_contact(x)
            & ~x.contains("|")
            & word_count(x).between(2, 6)
            & ~x.endswith(":"),
        ),
        F.lit(0),
    )


def headline(header: Column, name: Column) -> Column:
    return F.get(
        F.filter(
            _until_heading(header, 12),
            lambda x: (name.isNull() | (x != name))
            & ~_is_contact(x)
            & ~x.contains("|")
            & word_count(x).between(1, 10),
        ),
        F.lit(0),
    )


def contact_location(header: Column) -> Column:
    """Place in a contact row such as phone | email | city | link."""
    rows = F.filter(header, lambda x: x.contains("|") & _is_contact(x))
    parts = F.flatten(F.transform(rows, lambda x: F.transform(F.split(x, r"\|"), strip)))
    return F.get(
        F.filter(
            parts,
            lambda p: ~_is_contact(p)
            & word_count(p).between(1, 6)
            & ~p.rlike(r"\d{4}"),
        ),
        F.lit(0),
    )


def structure_documents(
    docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Text table to canonical resume table, one narrow stage without a shuffle; ``keep`` names columns that stay."""
    found = F.col("_sections")
    base = docs.select(key, *keep, normal_text(F.col(text)).alias("_text")).withColumn(
        "_sections", segments(F.col("_text"))
    )
    part = {
        name: section_text_lines(found, name) for name in vocab.SECTION_ORDER
    }
    header = F.col("_header")
    staged = (
        base.withColumn("_header", part["header"])
        .withColumn("_name", person_name(header))
        .withColumn("_headline", headline(header, F.col("_name")))
        .withColumn("_links", contact.links(F.col("_text")))
    )
    summary = blank_to_null(strip(F.array_join(reflow(part["summary"]), " ")))
    content = F.struct(
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.struct(
            F.col("_name").alias("name"),
            contact.email(F.col("_text")).alias("email"),
            contact.phone(F.col("_text")).alias("phone"),
            contact_location(header).alias("location"),
            F.col("_links").alias("links"),
        ).alias("contact"),
        F.col("_headline").alias("headline"),
        summary.alias("summary"),
        experience(part["experience"]).alias("experience"),
        education(part["education"]).alias("education"),
        skills(part["skills"]).alias("skills"),
        projects(part["projects"]).alias("projects"),
        certifications(part["certifications"]).alias("certifications"),
        awards(part["awards"]).alias("awards"),
        skill_items(F.array_join(part["languages"], " ")).alias("languages"),
        _no_strings().alias("hobbies"),
        F.struct(
            F.col("_headline").alias("job_title"),
            F.lit(None).cast("string").alias("work_authorization"),
            F.lit(None).cast("string").alias("notes"),
        ).alias("personal"),
        F.col("_links").alias("links"),
    )
    return staged.select(key, *keep, content.cast(schemas.RESUME_CONTENT).alias("content"))
