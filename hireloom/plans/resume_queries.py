"""Resume content, versions and tailoring queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.functions.text import str_array
from hireloom.operators import canonical as c
from hireloom.operators import resumes as r
from hireloom.operators import tailoring as t
from hireloom.operators.ordered import neighbour
from hireloom.plans import oracle as o
from hireloom.plans.registry import query
from hireloom.sources import bindings as b

R = o.with_(o.RESUMES)


def _payload(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumes as JSON that uses alias keys, mixed skill items and "Present"."""
    rid = F.col("resume_id")
    first, rest = F.col("skills")[0], F.slice("skills", 2, 1000000)
    mixed = F.concat(
        F.lit("["),
        F.array_join(
            F.concat(
                F.array(F.to_json(F.struct(first.alias("name")))),
                F.transform(rest, lambda s: F.concat(F.lit('"'), s, F.lit(' "'))),
            ),
            ",",
        ),
        F.lit("]"),
    )
    role = F.col("experience")[0]
    body = _payload(
        {
            "contact": F.struct(
                F.concat(F.lit("  "), F.col("name")).alias("name"),
                F.when(rid % 2 == 0, F.concat(F.lit("m"), rid.cast("string"), F.lit("@x.example")))
                .alias("email"),
                F.lit("https://a.example, https://b.example").alias("links"),
            ),
            "personal": F.struct(F.col("headline").alias("job_title")),
            "summary": F.when(rid % 3 == 0, F.col("summary")).otherwise("  "),
            "experience": F.array(
                F.struct(
                    role["title"].alias("role"),
                    role["company"].alias("organization"),
                    F.lit("2020").alias("start"),
                    F.when(rid % 2 == 0, "Present").otherwise("2023").alias("end_date"),
                    role["bullets"].alias("achievements"),
                )
            ),
            "education": F.when(
                rid % 5 != 0,
                F.array(
                    F.struct(
                        F.lit("City School").alias("school"), F.lit("Physics").alias("major"),
                        F.lit(8.5).alias("gpa"), F.lit(2019).alias("year"),
                    )
                ),
            ),
            "languages": F.array(F.lit("English")),
        }
    )
    return b.spread(b.resumes(spark, sf_dir)).select(
        "resume_id",
        F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"skills":'), mixed, F.lit("}")).alias(
            "body"
        ),
    )


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loose(spark, sf_dir).select(
        "resume_id", c.canonical(F.try_parse_json("body")).alias("content")
    )


CONF = """round(0.1 + CASE WHEN resume_id % 2 = 0 THEN 0.1 ELSE 0 END + 0.05
  + CASE WHEN resume_id % 3 = 0 THEN 0.1 ELSE 0 END + 0.25
  + CASE WHEN resume_id % 5 <> 0 THEN 0.15 ELSE 0 END + 0.1, 2)::DOUBLE"""


@query("canonical_resumes", f"""{R} SELECT resume_id, '1.1' AS schema_version, name,
  CASE WHEN resume_id % 2 = 0 THEN 'm' || resume_id || '@x.example' END AS email,
  'https://a.example|https://b.example' AS links, headline,
  CASE WHEN resume_id % 3 = 0 THEN summary END AS summary, headline AS role_title,
  segment AS role_company, '2020' AS role_start,
  CASE WHEN resume_id % 2 <> 0 THEN '2023' END AS role_end, resume_id % 2 = 0 AS role_current,
  bullet AS role_bullets, CASE WHEN resume_id % 5 <> 0 THEN 'City School' END AS school,
  CASE WHEN resume_id % 5 <> 0 THEN 'Physics' END AS major,
  CASE WHEN resume_id % 5 <> 0 THEN '8.5' END AS score,
  CASE WHEN resume_id % 5 <> 0 THEN '2019' END AS graduated,
  array_to_string(skills, ',') AS skills, 'English' AS languages FROM resumes""")
def canonical_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("content")
    role, school = k["experience"][0], F.get(k["education"], F.lit(0))
    return _contents(spark, sf_dir).select(
        "resume_id", k["schema_version"].alias("schema_version"),
        k["contact"]["name"].alias("name"), k["contact"]["email"].alias("email"),
        F.array_join(k["contact"]["links"], "|").alias("links"), k["headline"].alias("headline"),
        k["summary"].alias("summary"), role["title"].alias("role_title"),
        role["company"].alias("role_company"), role["start_date"].alias("role_start"),
        role["end_date"].alias("role_end"), role["is_current"].alias("role_current"),
        F.array_join(role["bullets"], "|").alias("role_bullets"),
        school["institution"].alias("school"), school["specialization"].alias("major"),
        school["score"].alias("score"), school["end_date"].alias("graduated"),
        F.array_join(k["skills"], ",").alias("skills"),
        F.array_join(k["languages"], ",").alias("languages"),
    )


@query("resume_confidence", f"""{R} SELECT resume_id, {CONF} AS confidence,
  {CONF} < 0.8 AS needs_review FROM resumes""")
def resume_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.validated(_contents(spark, sf_dir)).select("resume_id", "confidence", "needs_review")


@query("content_checksums", f"""{R} SELECT count(*) AS n,
  count(DISTINCT (name, headline, segment, bullet, array_to_string(skills, ','), resume_id)) AS distinct_contents
FROM resumes""")
def content_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.validated(_contents(spark, sf_dir)).agg(
        F.count("*").alias("n"), F.count_distinct("content_checksum").alias("distinct_contents")
    )


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor payloads with wrappers, leaked rows, fences and broken JSON."""
    rid = F.col("resume_id")
    title = F.col("headline")

    def job(name: Column, company: Column) -> Column:
        return F.struct(
            name.alias("job_title"), company.alias("company"), F.lit("2020").alias("start_date"),
            F.lit("Present").alias("end_date"),
            F.array(F.lit("Kept stock"), F.lit("Skills")).alias("achievements"),
        )

    good = job(title, F.initcap(F.element_at("skills", 1)))
    body = F.to_json(
        F.struct(
            F.struct(F.col("name").alias("value"), F.lit(0.9).alias("confidence")).alias(
                "full_name"
            ),
            title.alias("headline"),
            F.lit(0.4).alias("headline_confidence"),
            F.lit("n/a").alias("email"),
            F.concat(F.col("summary"), F.lit("\nSkills")).alias("summary"),
            F.lit("Built pipelines and improved them for many good teams").alias("location"),
            F.concat(
                "skills", F.array(F.lit("Skills"), F.lit("one two three four five six"))
            ).alias("skills"),
            F.struct(F.array(F.lit("dbt")).alias("data")).alias("skill_groups"),
            F.array(F.lit("English"), F.lit("Python"), F.lit("Old High German")).alias("languages"),
            F.array(
                good, good, job(F.lit("• Did things"), F.lit("Acme")),
                job(F.lit("Engineer"), F.lit("Developed a tool")),
                job(F.lit("Education"), F.lit("Acme")),
            ).alias("experience"),
            F.array(
                F.struct(F.concat(title, F.lit(" Jan 2020 – Present")).alias("title")),
                F.struct(F.lit("EDUCATION").alias("title")),
            ).alias("projects"),
            F.array(
                F.struct(F.lit("BSc").alias("degree"), F.lit("3.9").alias("gpa")),
                F.struct(F.lit("bsc").alias("degree"), F.lit("3.9").alias("gpa")),
            ).alias("education"),
            F.array(
                F.struct(F.lit("Projects done").alias("name")), F.struct(F.lit("CKA").alias("name"))
            ).alias("certifications"),
            F.lit("https://g.example").alias("github"),
        )
    )
    return b.spread(b.resumes(spark, sf_dir)).select(
        "resume_id",
        F.when(rid % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(rid % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
        .when(rid % 4 == 2, body)
        .otherwise("{broken")
        .alias("body"),
    )


@query("repaired_payloads", f"""{R} SELECT resume_id, name, CAST(NULL AS VARCHAR) AS email,
  CAST(NULL AS VARCHAR) AS location, summary, headline AS roles,
  'Kept stock' AS bullets, true AS role_current, headline AS projects, 'Jan 2020' AS project_start,
  1 AS n_education, 'gpa' AS score_type, 'CKA' AS certifications,
  array_to_string(skills, ',') || ',dbt,Python' AS skills, 'English' AS languages,
  'https://g.example' AS links
FROM resumes WHERE resume_id % 4 <> 3""")
def repaired_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = c.repair_payloads(_extracted(spark, sf_dir), "resume_id", "body")
    k = F.col("content")

    def titles(part: str) -> Column:
        return F.array_join(F.transform(k[part], lambda e: e["title"]), "|").alias(
            "roles" if part == "experience" else part
        )

    return good.select(
        "resume_id", k["contact"]["name"].alias("name"), k["contact"]["email"].alias("email"),
        k["contact"]["location"].alias("location"), k["summary"].alias("summary"),
        titles("experience"), F.array_join(k["experience"][0]["bullets"], "|").alias("bullets"),
        k["experience"][0]["is_current"].alias("role_current"), titles("projects"),
        k["projects"][0]["start_date"].alias("project_start"),
        F.size(k["education"]).alias("n_education"),
        k["education"][0]["score_type"].alias("score_type"), titles("certifications"),
        F.array_join(k["skills"], ",").alias("skills"),
        F.array_join(k["languages"], ",").alias("languages"),
        F.array_join(k["links"], ",").alias("links"),
    )


@query("payload_rejects", f"""{R} SELECT resume_id, 'invalid_json' AS reason FROM resumes
WHERE resume_id % 4 = 3""")
def payload_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.repair_payloads(_extracted(spark, sf_dir), "resume_id", "body")[1]


@query("merged_contents", f"""{R} SELECT resume_id,
  CASE WHEN resume_id % 2 = 0 THEN 'm' || resume_id || '@x.example' END AS email,
  CASE WHEN resume_id % 3 = 0 OR resume_id % 4 <> 3 THEN summary END AS summary,
  CASE WHEN resume_id % 5 <> 0 THEN 'City School' WHEN resume_id % 4 <> 3 THEN 'BSc' END AS school,
  CASE WHEN resume_id % 4 <> 3 THEN 1 ELSE 0 END AS n_projects FROM resumes""")
def merged_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = c.repair_payloads(_extracted(spark, sf_dir), "resume_id", "body")
    k = F.col("content")
    school = F.get(k["education"], F.lit(0))
    return c.merge_contents(_contents(spark, sf_dir), good, "resume_id").select(
        "resume_id", k["contact"]["email"].alias("email"), k["summary"].alias("summary"),
        F.coalesce(school["institution"], school["degree"]).alias("school"),
        F.size(k["projects"]).alias("n_projects"),
    )


@query("profile_contents", f"""{R} SELECT resume_id, headline,
  CASE WHEN resume_id % 3 = 2 THEN summary END AS summary,
  CASE WHEN resume_id % 3 = 2 THEN 0 ELSE 1 END AS n_skills,
  CASE WHEN resume_id % 3 = 2 THEN location END AS location FROM resumes""")
def profile_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested resume, bare content, or flat profile columns, by profile id."""
    rid = F.col("resume_id")
    content = F.struct(
        F.col("headline").alias("headline"), F.slice("skills", 1, 1).alias("skills")
    )
    data = (
        F.when(rid % 3 == 0, F.to_json(F.struct(content.alias("resume"))))
        .when(rid % 3 == 1, F.to_json(content))
        .otherwise('{"theme":"dark"}')
    )
    k = F.col("content")
    return (
        b.resumes(spark, sf_dir)
        .withColumn("_data", F.try_parse_json(data))
        .withColumn(
            "content",
            c.profile_content(
                F.col("_data"), F.col("headline"), F.col("summary"), F.col("location")
            ),
        )
        .select(
            "resume_id", k["headline"].alias("headline"), k["summary"].alias("summary"),
            F.size(k["skills"]).alias("n_skills"), k["contact"]["location"].alias("location"),
        )
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each resume beside the posting of the same number and its company."""
    null = F.lit(None).cast("string")
    entry = F.transform(
        "experience",
        lambda e: F.struct(
            F.lit("experience_01").alias("id"), e["company"].alias("company"),
            e["title"].alias("title"), null.alias("location"), null.alias("start_date"),
            null.alias("end_date"), F.lit(False).alias("is_current"), e["summary"].alias("summary"),
            e["bullets"].alias("bullets"), str_array([]).alias("source_fact_ids"),
        ),
    )
    content = F.struct(
        F.struct(
            F.col("name").alias("name"), null.alias("email"), null.alias("phone"),
            F.col("location").alias("location"), str_array([]).alias("links"),
        ).alias("contact"),
        F.when(F.col("resume_id") % 3 != 0, F.col("headline")).alias("headline"),
        F.when(F.col("resume_id") % 4 != 0, F.col("summary")).alias("summary"),
        F.col("skills").alias("skills"),
        entry.alias("experience"),
    )
    posting = b.postings(spark, sf_dir).select(
        "posting_id", "company_id", "title", "description", F.col("skills").alias("wanted")
    )
    company = b.companies(spark, sf_dir).select("company_id", "company_name")
    return (
        b.resumes(spark, sf_dir)
        .select("resume_id", content.alias("content"))
        .join(posting, F.col("resume_id") == F.col("posting_id"))
        .join(company, "company_id", "left")
    )


def _title(expr: str) -> str:
    return (
        f"CASE WHEN {expr} = lower({expr}) AND regexp_matches({expr}, '[a-z]') THEN array_to_string("
        f"list_transform(regexp_extract_all({expr}, '[a-z]+|[^a-z]+'), "
        f"lambda w: upper(w[1]) || w[2:]), '') ELSE {expr} END"
    )


PAIR = f"""{o.with_(o.RESUMES, o.POSTINGS, o.COMPANIES)}, pair AS (
  SELECT r.resume_id, r.name, r.location AS home, r.skills AS have, r.segment, r.bullet, r.headline AS role,
    CASE WHEN resume_id % 3 <> 0 THEN r.headline END AS headline,
    CASE WHEN resume_id % 4 <> 0 THEN r.summary END AS summary, p.title, c.company_name,
    list_sort(list_filter(list_distinct([lower(s) FOR s IN p.skills]),
      lambda s: NOT list_contains([lower(h) FOR h IN r.skills], s))) AS missing,
    list_sort(list_filter(list_distinct([lower(s) FOR s IN p.skills]),
      lambda s: list_contains([lower(h) FOR h IN r.skills], s))) AS matched
  FROM resumes r JOIN postings p ON p.posting_id = r.resume_id
  LEFT JOIN companies c ON c.company_id = p.company_id),
words AS (SELECT *, regexp_replace(title, '^(Senior|Junior) ', '') AS focus,
    [{_title("s")} FOR s IN missing] AS missing_shown, [{_title("s")} FOR s IN matched] AS matched_shown
  FROM pair),
proposed AS (SELECT *, regexp_replace(focus, 'Mid-level', 'Mid level') AS bits FROM words),
after AS (SELECT *,
    bits || coalesce(' | ' || company_name, '') AS new_headline,
    'Targeting ' || title || ' at ' || coalesce(company_name, 'this company') || '. '
      || coalesce(summary, 'Experienced professional delivering measurable outcomes.')
      || ' Emphasizing ' || coalesce(nullif(array_to_string(CASE WHEN len(missing) > 0
        THEN missing_shown ELSE matched_shown END, ', '), ''), 'relevant domain skills')
      || ' aligned to this posting.' AS new_summary,
    'Applied ' || array_to_string(missing_shown, ', ')
      || ' to deliver outcomes relevant to ' || title || '.' AS new_bullet FROM proposed)"""


@query("tailor_suggestions", f"""{PAIR}
SELECT resume_id, 'headline' AS id, headline AS before, new_headline AS after FROM after
WHERE lower(coalesce(headline, '')) <> lower(new_headline)
UNION ALL SELECT resume_id, 'summary', summary, new_summary FROM after
UNION ALL SELECT resume_id, 'skills', array_to_string(have, '|'),
  array_to_string(list_concat(have, missing_shown), '|') FROM after WHERE len(missing) > 0
UNION ALL SELECT resume_id, 'experience_0_bullets', bullet, bullet || '|' || new_bullet
FROM after WHERE len(missing) > 0""")
def tailor_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.suggest(_pairs(spark, sf_dir)).select("resume_id", F.inline("suggestions"))
    return rows.select(
        "resume_id", "id",
        F.coalesce("before", F.array_join("before_list", "|")).alias("before"),
        F.coalesce("after", F.array_join("after_list", "|")).alias("after"),
    )


@query("tailor_applied", f"""{PAIR}
SELECT resume_id, new_headline AS headline, summary, array_to_string(CASE WHEN len(missing) > 0
  THEN list_concat(have, missing_shown) ELSE have END, '|') AS skills, bullet AS bullets FROM after""")
def tailor_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the headline and the skills are selected."""
    chosen = str_array(["headline", "skills"])
    return t.apply_suggestions(t.suggest(_pairs(spark, sf_dir)), chosen).select(
        "resume_id", "proposed.headline", "proposed.summary",
        F.array_join("proposed.skills", "|").alias("skills"),
        F.array_join(F.col("proposed.experience")[0]["bullets"], "|").alias("bullets"),
    )


@query("cover_letters", f"""{PAIR}, l AS (SELECT *, coalesce(company_name, 'your team') AS who,
  CASE WHEN len(matched) > 0 THEN matched_shown
    ELSE list_transform(have, lambda s: {_title("lower(s)")}) END AS shown FROM after)
SELECT resume_id, 'Application for ' || title || ' — ' || name AS subject,
  name || chr(10) || home || chr(10) || chr(10) || 'Dear Hiring Manager,' || chr(10) || chr(10)
  || 'I am writing to apply for the ' || title || ' position at ' || who || '. I am a '
  || coalesce(headline || ', ', '') || 'most recently as ' || role || ' at ' || segment || '.'
  || chr(10) || chr(10) || 'My background includes hands-on work with ' || array_to_string(shown, ', ')
  || ', which aligns closely with the requirements for this role.' || chr(10) || chr(10)
  || 'In my recent work, d' || bullet[2:] || '.' || chr(10) || chr(10)
  || 'I am especially interested in ' || who || ' because this ' || title
  || ' role is a strong fit for my experience building and operating data systems at scale.'
  || chr(10) || chr(10) || '{t.CLOSING}' || chr(10) || chr(10) || 'Sincerely,' || chr(10) || name
  || chr(10) AS letter FROM l""")
def cover_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.letters(_pairs(spark, sf_dir)).select("resume_id", "subject", "letter")


VERSIONS = """
resume_rows AS (SELECT c_custkey AS resume_id, c_custkey // 3 AS profile_id,
    CASE c_custkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'extracted' WHEN 2 THEN 'needs_review'
      ELSE 'parse_failed' END AS status,
    CASE WHEN c_custkey % 2 = 0 THEN (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c_custkey)
      END AS active_version_id,
    CASE WHEN c_custkey % 3 = 0 THEN 'users/' || c_custkey END AS source_object_key,
    make_timestamp((1700000000 + (c_custkey * 7919) % 100000)::BIGINT * 1000000) AS created_at
  FROM customer),
versions AS (SELECT o_orderkey AS version_id, o_custkey AS resume_id, o_orderkey::INT AS version_number,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey // 2 END AS content_id,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_version_id,
    o_orderkey % 50 AS posting_id FROM orders),
active AS (SELECT resume_id, v.version_id, v.content_id FROM versions v JOIN resume_rows USING (resume_id)
  QUALIFY row_number() OVER (PARTITION BY resume_id
    ORDER BY (v.version_id = active_version_id) IS NOT TRUE, version_number) = 1)"""


def _resume_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    newest = (
        b.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_orderkey").alias("_newest"))
    )
    return b.table(spark, sf_dir, "customer").join(newest, "c_custkey", "left").select(
        key.alias("resume_id"),
        F.floor(key / 3).alias("profile_id"),
        F.when(key % 4 == 0, "verified").when(key % 4 == 1, "extracted")
        .when(key % 4 == 2, "needs_review").otherwise("parse_failed").alias("status"),
        F.when(key % 2 == 0, F.col("_newest")).alias("active_version_id"),
        F.when(key % 3 == 0, F.concat(F.lit("users/"), key.cast("string"))).alias(
            "source_object_key"
        ),
        F.timestamp_seconds(F.lit(1700000000) + (key * 7919) % 100000).alias("created_at"),
    )


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as resume versions; the order before it is the parent of each."""
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("resume_id"),
        F.col("o_orderkey").cast("int").alias("version_number"),
        F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_orderkey") / 2)).alias("content_id"),
        (F.col("o_orderkey") % 50).alias("posting_id"),
    )
    return neighbour(
        rows, ["resume_id"], ["version_id"], F.col("version_id"), "parent_version_id",
        F.floor(F.col("version_id") / 100000),
    )


@query("active_versions", f"WITH {VERSIONS} SELECT resume_id, version_id FROM active")
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.active_versions(_resume_rows(spark, sf_dir), _versions(spark, sf_dir)).select(
        "resume_id", "version_id"
    )


@query("resume_for_matching", f"""WITH {VERSIONS}
SELECT profile_id, resume_id, version_id FROM resume_rows JOIN active USING (resume_id)
WHERE status IN ('verified', 'extracted', 'needs_review') AND content_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created_at DESC, resume_id DESC) = 1""")
def resume_for_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.resume_for_matching(_resume_rows(spark, sf_dir), _versions(spark, sf_dir)).select(
        "profile_id", "resume_id", "version_id"
    )


@query("active_preferences", """SELECT o_custkey AS profile_id, max(o_orderkey) AS version
FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def active_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("version"),
        (F.col("o_orderstatus") == "O").alias("is_active"),
    )
    return r.active_preferences(rows).select("profile_id", "version")


@query("resume_list", f"""WITH {VERSIONS}
SELECT resume_id, profile_id FROM resume_rows WHERE source_object_key IS NOT NULL""")
def resume_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.listed(_resume_rows(spark, sf_dir), "uploaded").select("resume_id", "profile_id")


@query("version_edits", f"""WITH {VERSIONS},
tops AS (SELECT resume_id, max(version_number) AS top FROM versions GROUP BY 1)
SELECT e.doc_id AS edit_id, top + 1 AS version_number, version_id::VARCHAR AS parent
FROM documents e JOIN tops ON resume_id = e.doc_id JOIN active USING (resume_id)""")
def version_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("edit_id"), F.col("doc_id").alias("resume_id"),
        F.struct(F.col("text").alias("summary")).alias("content"),
    )
    versions = _versions(spark, sf_dir)
    fresh, _ = r.edited_versions(_resume_rows(spark, sf_dir), versions, edits)
    known = versions.select("resume_id").distinct()
    return fresh.join(known, "resume_id", "left_semi").select(
        F.col("resume_id").alias("edit_id"), "version_number",
        F.col("parent_version_id").alias("parent"),
    )


@query("generated_versions", f"""{PAIR}
SELECT resume_id AS posting_id, 1 AS version_number, 'generated' AS kind, resume_id AS parent
FROM after""")
def generated_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = t.apply_suggestions(t.suggest(_pairs(spark, sf_dir))).select(
        F.col("resume_id").alias("parent_version_id"), "posting_id",
        F.col("proposed").alias("content"),
    )
    return r.generated_versions(proposed).select(
        "posting_id", "version_number", "kind", F.col("parent_version_id").alias("parent")
    )


@query("version_lineage", f"""{o.with_(VERSIONS, o.POSTINGS)}
SELECT v.version_id, p.version_number AS parent_number, t.title AS posting_title
FROM versions v LEFT JOIN versions p ON p.version_id = v.parent_version_id
LEFT JOIN postings t ON t.posting_id = v.posting_id""")
def version_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.lineage(_versions(spark, sf_dir), b.postings(spark, sf_dir)).select(
        "version_id", "parent_number", "posting_title"
    )


@query("version_ancestry", f"""WITH RECURSIVE {VERSIONS}, {o.POSTINGS},
chain(version_id, root_version_id, depth) AS (
  SELECT version_id, version_id, 0 FROM versions WHERE parent_version_id IS NULL
  UNION ALL
  SELECT v.version_id, root_version_id, depth + 1 FROM versions v JOIN chain c ON v.parent_version_id = c.version_id)
SELECT c.version_id, root_version_id, depth::BIGINT AS depth, false AS cyclic, t.title AS root_posting_title
FROM chain c JOIN versions r ON r.version_id = root_version_id LEFT JOIN postings t ON t.posting_id = r.posting_id""")
def version_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version behind each one, how many edits lie between, and what the first was written for."""
    versions, posted = _versions(spark, sf_dir), b.postings(spark, sf_dir)
    first = r.lineage(versions, posted).select(F.col("version_id").alias("root_version_id"), F.col("posting_title").alias("root_posting_title"))
    return r.ancestry(versions).join(first, "root_version_id", "left").select(
        "version_id", "root_version_id", "depth", "cyclic", "root_posting_title"
    )


@query("resume_delete", f"""WITH {VERSIONS},
kept AS (SELECT * FROM versions WHERE resume_id % 7 <> 0),
gone AS (SELECT * FROM versions WHERE resume_id % 7 = 0)
SELECT 'versions' AS kind, version_id AS id FROM kept
UNION ALL SELECT 'contents', content_id FROM (
  SELECT DISTINCT content_id FROM versions WHERE content_id IS NOT NULL)
WHERE content_id IN (SELECT content_id FROM kept WHERE content_id IS NOT NULL)""")
def resume_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _versions(spark, sf_dir)
    gone = _resume_rows(spark, sf_dir).filter(F.col("resume_id") % 7 == 0)
    contents = versions.select("content_id").filter(F.col("content_id").isNotNull()).distinct()
    _, kept, used = r.delete_resumes(gone, _resume_rows(spark, sf_dir), versions, contents)
    return kept.select(F.lit("versions").alias("kind"), F.col("version_id").alias("id")).unionByName(
        used.select(F.lit("contents").alias("kind"), F.col("content_id").alias("id"))
    )
