"""Page, document and resume-text queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom import vocab
from hireloom.functions import contact, html
from hireloom.functions.skills import display_skill, inferred_skills
from hireloom.functions.text import str_array
from hireloom.operators import entries, grounding, metrics, sections
from hireloom.plans import oracle as o
from hireloom.plans.registry import query
from hireloom.sources import bindings as b
from hireloom.sources import pages as pg
from hireloom.sources import uploads

R = o.with_(o.RESUMES)
P = o.with_(o.POSTINGS)


def _sql_strip(expr: str) -> str:
    out = f"regexp_replace({expr}, '<br\\s*/?>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '</(p|li|h\\d|div)>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, char in (
        ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"),
        ("&quot;", "'\"'"), ("&#39;", "''''"),
    ):
        out = f"replace({out}, '{entity}', {char})"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif(regexp_replace(regexp_replace({out}, '^\\s+', ''), '\\s+$', ''), '')"


@query("page_text", f"""SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest
FROM (SELECT page_id, {_sql_strip("html")} AS t FROM pages)""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.strip_html(F.col("html"))
    return b.table(spark, sf_dir, "pages").select(
        "page_id", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("digest")
    )


@query("page_fields", f"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS page_url,
  {_sql_strip("nullif(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 'is'), '')")} AS title
FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.read_pages(b.table(spark, sf_dir, "pages")).select(
        "page_id", html.page_url(F.col("url")).alias("page_url"), F.col("page.title").alias("title")
    )


def _job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as job pages in five layouts, by posting id."""
    key = F.col("posting_id")
    number = (F.lit(1000000) + key).cast("string")
    place = F.coalesce("location", F.lit("Pune"))
    company = F.col("skills")[2]
    markup = F.concat(
        F.lit('<html><h2 class="x top-card-layout__title y">\n '), "title",
        F.lit(' </h2><a class="topcard__org-name-link" href="#">'), company,
        F.lit('</a><span class="topcard__flavor topcard__flavor--bullet"> '), place,
        F.lit('</span><div class="show-more-less-html__markup">We use Python &amp; SQL.<br>'),
        "description", F.lit("</div></html>"),
    )
    posting = F.to_json(
        F.struct(
            F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"),
            F.col("title").alias("title"),
            F.struct(company.alias("name")).alias("hiringOrganization"),
            F.concat(F.lit("<p>"), "description", F.lit(" kafka</p>")).alias("description"),
            F.struct(
                F.struct(
                    place.alias("addressLocality"), F.lit("IN").alias("addressCountry")
                ).alias("address")
            ).alias("jobLocation"),
        )
    )
    json_ld = F.concat(
        F.lit('<script type="application/ld+json">{broken</script>'
              '<script type="application/ld+json">[{"@type":"Thing"},'),
        posting, F.lit("]</script>"),
    )
    og = F.concat(
        F.lit('<meta property="og:title" content="'), company, F.lit(" hiring "), "title",
        F.lit(" in "), place, F.lit(' | LinkedIn"><meta property="og:description" content="'),
        "description", F.lit('">'),
    )
    payload = F.to_json(
        F.struct(
            F.struct(F.col("title").alias("text")).alias("title"),
            F.struct(company.alias("companyName")).alias("companyDetails"),
            F.struct(F.concat(F.lit("<b>"), "description", F.lit("</b>")).alias("text")).alias(
                "description"
            ),
            place.alias("formattedLocation"),
        )
    )
    layout = key % 5
    url = (
        F.when(key % 7 == 0, F.lit("https://example.com/none"))
        .when(key % 2 == 0, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number,
                                     F.lit("/?trk=x")))
        .otherwise(F.concat(F.lit("https://x.example/search?currentJobId="), number))
    )
    return b.spread(b.postings(spark, sf_dir)).select(
        key.alias("page_id"),
        url.alias("url"),
        F.when(layout == 0, markup).when(layout == 1, json_ld).when(layout == 2, og)
        .when(layout == 3, payload).otherwise("<p>nothing</p>").alias("html"),
    )


@query("job_pages", f"""{P}, p AS (SELECT *, coalesce(location, 'Pune') AS place FROM postings
  WHERE posting_id % 7 <> 0 AND posting_id % 5 <> 4)
SELECT (1000000 + posting_id)::VARCHAR AS external_id, title, skills[3] AS company_name,
  CASE posting_id % 5 WHEN 1 THEN place || ', IN' ELSE place END AS location,
  CASE posting_id % 5 WHEN 0 THEN 'We use Python & SQL.' || chr(10) || description
    WHEN 1 THEN description || ' kafka' ELSE description END AS description,
  CASE WHEN contains(lower(place || ' ' || description), 'remote') THEN 'remote'
    WHEN contains(lower(place || ' ' || description), 'hybrid') THEN 'hybrid' ELSE 'onsite' END
    AS remote_type,
  'https://www.linkedin.com/jobs/view/' || (1000000 + posting_id) || '/' AS canonical_url,
  CASE posting_id % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'json_ld' WHEN 2 THEN 'og_meta' ELSE 'json' END
    AS found_by
FROM p""")
def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pg.postings_from_pages(_job_pages(spark, sf_dir))
    return found.select(
        "external_id", "title", "company_name", "location", "description", "remote_type",
        "canonical_url", F.get_json_object("raw_payload", "$.source").alias("found_by"),
    )


@query("job_page_rejects", f"""{P} SELECT posting_id AS page_id,
  CASE WHEN posting_id % 7 = 0 THEN 'invalid_url' ELSE 'fetch_failed' END AS reason
FROM postings WHERE posting_id % 7 = 0 OR posting_id % 5 = 4""")
def job_page_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.postings_from_pages(_job_pages(spark, sf_dir))[1].select("page_id", "reason")


@query("pasted_postings", """SELECT doc_id,
  trim(list_filter(string_split(trim(text, E' \\t\\n'), chr(10)),
    lambda x: trim(x) <> '')[1]) AS title FROM documents""")
def pasted_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", pg.from_pasted(F.col("text"))["title"].alias("title")
    )


TERMS = "[" + ", ".join(f"'{t}'" for t in vocab.SKILL_TERMS) + "]"


def _skill_text() -> Column:
    terms, n = str_array(vocab.SKILL_TERMS), len(vocab.SKILL_TERMS)
    key = F.col("p_partkey")

    def term(k: Column) -> Column:
        return F.upper(terms[(k % n).cast("int")])

    return F.concat_ws(" and ", term(key), term(key * 7 + 3), term(key * 13 + 5), F.col("p_name"))


@query("skill_tags", f"""WITH t AS (SELECT p_partkey, lower({TERMS}[p_partkey % 58 + 1] || ' and '
    || {TERMS}[(p_partkey * 7 + 3) % 58 + 1] || ' and ' || {TERMS}[(p_partkey * 13 + 5) % 58 + 1]
    || ' and ' || p_name) AS body FROM part),
d AS (SELECT unnest({TERMS}) AS term),
hits AS (SELECT p_partkey, term FROM t, d WHERE contains(body, term)),
kept AS (SELECT * FROM hits h WHERE NOT EXISTS (
  SELECT 1 FROM hits l WHERE l.p_partkey = h.p_partkey AND l.term <> h.term AND contains(l.term, h.term)))
SELECT p_partkey, array_to_string(list(term ORDER BY term), ',') AS skills FROM kept GROUP BY 1""")
def skill_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = b.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_sort(inferred_skills(_skill_text())).alias("skills")
    )
    return tagged.filter(F.size("skills") > 0).select(
        "p_partkey", F.array_join("skills", ",").alias("skills")
    )


ALIAS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SKILL_DISPLAY.items())


@query("skill_display", f"""WITH d AS (SELECT p_partkey, {TERMS}[p_partkey % 58 + 1] AS term FROM part)
SELECT term, CASE term {ALIAS_SQL} ELSE array_to_string(list_transform(
    regexp_extract_all(term, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') END AS shown,
  count(*) AS n FROM d GROUP BY 1, 2""")
def skill_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = str_array(vocab.SKILL_TERMS)[(F.col("p_partkey") % len(vocab.SKILL_TERMS)).cast("int")]
    return (
        b.table(spark, sf_dir, "part")
        .select(term.alias("term"))
        .groupBy("term", display_skill(F.col("term")).alias("shown"))
        .agg(F.count("*").alias("n"))
    )


@query("document_lines", """SELECT doc_id, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::INT
    AS n_lines,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))::INT AS n_filled
FROM documents""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sections.text_lines(F.col("text"))
    return b.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(lines).alias("n_lines"),
        F.size(F.filter(lines, lambda x: x != "")).alias("n_filled"),
    )


TITLE = "array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(headline, ' ')], ' ')"
MAIL = "'c' || resume_id || '@mail.example.com'"


@query("section_segments", f"""{R}, r AS (SELECT *, {TITLE} AS shown FROM resumes)
SELECT resume_id, section, text, start_line, end_line FROM (
  SELECT resume_id, 'header' AS section, 1 AS start_line, 4 AS end_line,
    name || chr(10) || shown || chr(10) || {MAIL} || ' | +91 98765 43210 | ' || location AS text FROM r
  UNION ALL SELECT resume_id, 'summary', 6, 7, summary FROM r
  UNION ALL SELECT resume_id, 'experience', 9, 15, shown || ' Lead | ' || segment || ' Works, '
    || location || ' FEB 2021 – PRESENT' || chr(10) || '• ' || bullet || ' on time' || chr(10)
    || 'and below the agreed budget' || chr(10) || '- Kept records' || chr(10) || 'Junior ' || shown
    || ' | Old Works, ' || location || ' Oct 2018 – Jan 2021' || chr(10) || '• Counted stock daily' FROM r
  UNION ALL SELECT resume_id, 'education', 17, 17,
    'BCA | College of ' || location || ', City Sep 2017 | 8.5 CGPA' FROM r
  UNION ALL SELECT resume_id, 'skills', 18, 18, array_to_string(skills, ', ') FROM r
  UNION ALL SELECT resume_id, 'languages', 20, 20, 'English, Hindi' FROM r)""")
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.segment_documents(b.resume_texts(spark, sf_dir), "resume_id").drop("line_ids")


@query("document_sections", """SELECT doc_id, 'header' AS section,
  regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM documents""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose without headings stays whole in its header section."""
    docs = b.table(spark, sf_dir, "documents")
    return sections.segment_documents(docs, "doc_id").select("doc_id", "section", "text")


def _structured(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return entries.structure_documents(b.spread(b.resume_texts(spark, sf_dir)), "resume_id", keep=keep)


@query("structured_resumes", f"""{R}, r AS (SELECT *, {TITLE} AS shown FROM resumes)
SELECT resume_id, name, {MAIL} AS email, '+91 98765 43210' AS phone, location, shown AS headline,
  summary, 2 AS n_roles, 'experience_01' AS role_id, shown || ' Lead' AS role_title,
  segment || ' Works' AS role_company, location AS role_location, 'FEB 2021' AS role_start,
  true AS role_current, bullet || ' on time and below the agreed budget|Kept records' AS role_bullets,
  'Junior ' || shown AS old_title, 'Oct 2018' AS old_start, 'Jan 2021' AS old_end,
  'BCA' AS degree, 'College of ' || location AS institution, 'City' AS school_place,
  'Sep 2017' AS graduated, '8.5' AS score, 'cgpa' AS score_type,
  array_to_string(skills, ',') AS skills,
  'English,Hindi' AS languages FROM r""")
def structured_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    role, old, school = c["experience"][0], c["experience"][1], c["education"][0]
    return _structured(spark, sf_dir).select(
        "resume_id", c["contact"]["name"].alias("name"), c["contact"]["email"].alias("email"),
        c["contact"]["phone"].alias("phone"), c["contact"]["location"].alias("location"),
        c["headline"].alias("headline"), c["summary"].alias("summary"),
        F.size(c["experience"]).alias("n_roles"), role["id"].alias("role_id"),
        role["title"].alias("role_title"), role["company"].alias("role_company"),
        role["location"].alias("role_location"), role["start_date"].alias("role_start"),
        role["is_current"].alias("role_current"),
        F.array_join(role["bullets"], "|").alias("role_bullets"),
        old["title"].alias("old_title"), old["start_date"].alias("old_start"),
        old["end_date"].alias("old_end"), school["degree"].alias("degree"),
        school["institution"].alias("institution"), school["location"].alias("school_place"),
        school["end_date"].alias("graduated"), school["score"].alias("score"),
        school["score_type"].alias("score_type"),
        F.array_join(c["skills"], ",").alias("skills"),
        F.array_join(c["languages"], ",").alias("languages"),
    )


TEXT_SQL = f"""name || chr(10) || {TITLE} || chr(10) || {MAIL} || ' | +91 98765 43210 | ' || location
  || chr(10) || chr(10) || 'Professional Summary' || chr(10) || summary || chr(10) || chr(10)
  || 'EXPERIENCE' || chr(10) || {TITLE} || ' Lead | ' || segment || ' Works, ' || location
  || ' FEB 2021 – PRESENT' || chr(10) || '• ' || bullet || ' on time' || chr(10)
  || 'and below the agreed budget' || chr(10) || '- Kept records' || chr(10) || 'Junior ' || {TITLE}
  || ' | Old Works, ' || location || ' Oct 2018 – Jan 2021' || chr(10) || '• Counted stock daily'
  || chr(10) || chr(10) || 'Education:' || chr(10) || 'BCA | College of ' || location
  || ', City Sep 2017 | 8.5 CGPA' || chr(10) || 'Skills: ' || array_to_string(skills, ', ')
  || chr(10) || 'Languages' || chr(10) || 'English, Hindi'"""


@query("grounded_roles", f"""{R},
l AS (SELECT resume_id, lower(trim(line)) AS line, no FROM (
  SELECT resume_id, unnest(string_split({TEXT_SQL}, chr(10))) AS line,
    generate_subscripts(string_split({TEXT_SQL}, chr(10)), 1) AS no FROM resumes)
  WHERE trim(line) <> ''),
n AS (SELECT resume_id, lower(x) AS needle, i FROM (
  SELECT resume_id, unnest([{TITLE} || ' Lead', segment || ' Works',
    bullet || ' on time and below the agreed budget', 'Kept records']) AS x,
    unnest([1, 2, 3, 4]) AS i FROM resumes)),
h AS (SELECT resume_id, no, min(i * 1000 + no) AS pos FROM n JOIN l USING (resume_id)
  WHERE contains(line, needle) OR (length(needle) > 24 AND contains(needle, line)) GROUP BY 1, 2)
SELECT resume_id, array_to_string(list('L' || lpad(no::VARCHAR, 3, '0') ORDER BY pos), ',') AS ids
FROM h GROUP BY 1""")
def grounded_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _structured(spark, sf_dir, "text")
    ids = F.col("content.experience")[0]["source_fact_ids"]
    return grounding.ground(docs).select("resume_id", F.array_join(ids, ",").alias("ids"))


@query("extraction_quality", f"""{R}
SELECT 'skill' AS field, 1.0 AS precision,
  1.0 AS recall, sum(len(skills))::BIGINT AS n_right FROM resumes
UNION ALL SELECT 'headline', round(avg((headline = {TITLE})::INT), 4),
  round(avg((headline = {TITLE})::INT), 4), count(*) FILTER (WHERE headline = {TITLE}) FROM resumes""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = b.resumes(spark, sf_dir), _structured(spark, sf_dir)

    def facts(df: DataFrame, skills: str, headline: str) -> DataFrame:
        pairs = F.array_append(
            F.transform(
                skills, lambda s: F.struct(F.lit("skill").alias("field"), s.alias("value"))
            ),
            F.struct(F.lit("headline").alias("field"), F.col(headline).alias("value")),
        )
        return df.select(F.col("resume_id").alias("doc_id"), F.inline(pairs))

    return metrics.extraction_quality(
        facts(truth, "skills", "headline"), facts(found, "content.skills", "content.headline")
    )


@query("provenance_coverage", f"""{R}
SELECT 'experience' AS section, 2 * count(*) AS records, 2 * count(*) AS grounded, 1.0 AS coverage FROM resumes
UNION ALL SELECT 'education', count(*), count(*) FILTER (WHERE resume_id % 2 = 0), round(avg((resume_id % 2 = 0)::INT), 4) FROM resumes
UNION ALL SELECT 'awards', 0, 0, NULL""")
def provenance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against a source text that has lost its education line for every other resume."""
    line = F.regexp_replace("text", r"BCA \| College[^\n]*", "")
    source = F.when(F.col("resume_id") % 2 == 0, F.col("text")).otherwise(line)
    docs = grounding.ground(_structured(spark, sf_dir, "text").withColumn("text", source))
    return metrics.provenance_coverage(docs, ["experience", "education", "awards"])


@query("contact_fields", """WITH t AS (SELECT doc_id, text,
    regexp_extract(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b') AS email,
    regexp_extract_all(text, '(?i)(?:https?://[^\\s)|]+|www\\.[^\\s)|]+|linkedin\\.com/[^\\s)|]+'
      || '|github\\.com/[^\\s)|]+)') AS links FROM documents)
SELECT doc_id, nullif(email, '') AS email, len(list_distinct(links))::INT AS n_links FROM t""")
def contact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return b.table(spark, sf_dir, "documents").select(
        "doc_id", contact.email(text).alias("email"), F.size(contact.links(text)).alias("n_links")
    )


@query("upload_register", """WITH f AS (SELECT doc_id, text, octet_length(encode(text)) AS n_bytes
  FROM documents)
SELECT 'in/résumé ' || doc_id || '.pdf' AS filename, n_bytes::BIGINT AS n_bytes,
  sha256(text) AS checksum, 'résumé ' || doc_id || '.pdf' AS title, 'pdf' AS extension, NULL AS reason
FROM f WHERE doc_id % 3 <> 0
UNION ALL SELECT 'in/résumé ' || doc_id || '.pdf', NULL, NULL, NULL, NULL, 'unsupported_type'
FROM f WHERE doc_id % 3 = 0""")
def upload_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("in/résumé "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias(
            "filename"
        ),
        F.when(F.col("doc_id") % 3 == 0, "text/plain").otherwise(
            "Application/PDF; charset=x"
        ).alias("mime_type"),
        F.encode("text", "UTF-8").alias("content"),
    )
    accepted, rejected = uploads.register(files)
    return accepted.drop("mime_type").unionByName(
        rejected.drop("mime_type"), allowMissingColumns=True
    )
