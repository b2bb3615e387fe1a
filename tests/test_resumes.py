import json

from pyspark.sql import functions as F

from hireloom.operators import canonical as c
from hireloom.operators import entries, grounding, sections
from hireloom.operators import tailoring as t
from hireloom.sources import pages, uploads

TEXT = """Ada Sample
Data Engineer
+91 98765 43210 | ada@mail.example.com | Pune | linkedin.com/in/ada

Professional Summary
Builds data
platforms.
EXPERIENCE
Software Engineer | Epsilon Works, Bangalore FEB 2024 – PRESENT
• Built pipelines in Spark and kept
them running at scale
- Cut cost
Intern | Techno Pvt. Ltd. , Tumkur OCT 2022 – FEB 2023
• Made pages
Projects
Tracky | Personal Platform Jan 2021 – Mar 2022
• Tracks work
Education:
MCA | Jain College, Bangalore Sep 2024 | 8.75 CGPA BCA | City College, Pune Jun 2021
SKILLS: Data Engineering: Spark, CI/CD, dbt
Certifications
Cloud Architect | Data Engineer Pro
Awards
• Star of the year
Languages: English, Hindi
"""


def structured(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id int, text string")
    return docs, entries.structure_documents(docs, "doc_id")


def test_sections_do_not_leak(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "just prose\nand more")], "doc_id int, text string")
    rows = sections.segment_documents(docs, "doc_id").collect()
    first = [r.section for r in rows if r.doc_id == 1]
    assert first == ["header", "summary", "experience", "projects", "education", "skills",
                     "certifications", "awards", "languages"]
    skills = next(r for r in rows if r.section == "skills")
    assert skills.text == "Data Engineering: Spark, CI/CD, dbt" and skills.line_ids == ["L020"]
    assert [(r.section, r.text) for r in rows if r.doc_id == 2] == [
        ("header", "just prose\nand more")
    ]


def test_structure_and_grounding(spark):
    docs, got = structured(spark)
    k = got.first().content
    assert (k.contact.name, k.headline, k.contact.location) == ("Ada Sample", "Data Engineer", "Pune")
    assert k.summary == "Builds data platforms."
    assert [(e.title, e.company, e.location, e.is_current) for e in k.experience] == [
        ("Software Engineer", "Epsilon Works", "Bangalore", True),
        ("Intern", "Techno Pvt. Ltd.", "Tumkur", False),
    ]
    assert k.experience[0].bullets == [
        "Built pipelines in Spark and kept them running at scale", "Cut cost",
    ]
    assert [(e.degree, e.institution, e.end_date, e.score) for e in k.education] == [
        ("MCA", "Jain College", "Sep 2024", "8.75"), ("BCA", "City College", "Jun 2021", None),
    ]
    assert k.skills == ["Spark", "CI/CD", "dbt"] and k.languages == ["English", "Hindi"]
    assert [x.title for x in k.certifications] == ["Cloud Architect", "Data Engineer Pro"]
    assert k.projects[0].title == "Tracky" and k.awards[0].title == "Star of the year"
    grounded = grounding.ground(got.join(docs, "doc_id")).first().content
    assert grounded.experience[0].source_fact_ids == ["L009", "L011", "L012"]


def test_structured_text_needs_no_review(spark):
    _, got = structured(spark)
    row = c.validated(got).first()
    assert row.confidence >= 0.8 and not row.needs_review and len(row.content_checksum) == 64


def canonical(spark, payload):
    df = spark.createDataFrame([(json.dumps(payload),)], "body string")
    return df.select(c.canonical(F.try_parse_json("body")).alias("k")).first().k


def test_canonical_defaults_and_aliases(spark):
    empty = canonical(spark, {})
    assert empty.schema_version == "1.1" and empty.skills == [] and empty.contact.name is None
    k = canonical(
        spark,
        {
            "schema_version": "1.0",
            "skills": ["SQL", {"name": "Spark"}, 4],
            "experience": [
                {"role": "Dev", "organization": "Acme", "end_date": "Present",
                 "achievements": "a, b"}, "noise",
            ],
            "education": [{"college": "C", "major": "M", "cgpa": 9.1, "graduation_date": "2020"}],
            "projects": [{"name": "P", "tech": ["x"], "details": ["did"]}],
            "certifications": [{"name": "N", "authority": "A", "credentialId": "7"}],
            "links": "https://a.example",
        },
    )
    e = k.experience[0]
    assert k.schema_version == "1.0" and len(k.experience) == 1
    assert (e.title, e.company, e.end_date, e.is_current, e.bullets) == (
        "Dev", "Acme", None, True, ["a", "b"],
    )
    assert k.skills[:2] == ["SQL", "Spark"]
    assert (k.education[0].institution, k.education[0].score, k.education[0].end_date) == (
        "C", "9.1", "2020",
    )
    assert k.projects[0].bullets == ["did"] and k.projects[0].technologies == ["x"]
    assert k.certifications[0].credential_id == "7" and k.contact.links == ["https://a.example"]


def page(spark, html, url="https://www.linkedin.com/jobs/view/1234567/", pasted=None):
    df = spark.createDataFrame(
        [(1, url, html, pasted)], "page_id long, url string, html string, pasted string"
    )
    found, rejects = pages.postings_from_pages(df, "pasted")
    return found.first(), rejects.first()


def test_page_cascade_and_override(spark):
    og = '<meta property="og:title" content="Acme hiring Data Engineer in Pune, India | LinkedIn">'
    row, _ = page(spark, og, pasted="Python and Kafka")
    assert (row.title, row.company_name, row.location) == ("Data Engineer", "Acme", "Pune, India")
    assert row.description == "Python and Kafka" and row.requirements.skills == ["Python", "Kafka"]
    places = ('<script type="application/ld+json">{"@type": "JobPosting", "title": "T", "jobLocation":'
              ' [{"address": {"addressLocality": "Oslo"}}], "description": "<p>x</p>"}</script>')
    row, _ = page(spark, places)
    assert (row.title, row.location, row.description) == ("T", "Oslo", "x")
    row, _ = page(spark, "<p></p>", pasted="\n  Clerk wanted \nmore")
    assert (row.title, row.company_name) == ("Clerk wanted", "LinkedIn posting")
    assert page(spark, "<p></p>")[1].reason == "fetch_failed"
    assert page(spark, og, url="https://x.example/")[1].reason == "invalid_url"


def test_tailoring_ids_and_selection(spark):
    _, got = structured(spark)
    pair = got.select(
        "content", F.lit("Senior Platform Engineer").alias("title"), F.lit("d").alias("description"),
        F.array(F.lit("Spark"), F.lit("kafka")).alias("wanted"), F.lit("Acme").alias("company_name"),
    )
    suggested = t.suggest(pair)
    row = suggested.first()
    assert [s.id for s in row.suggestions] == ["headline", "summary", "skills", "experience_0_bullets"]
    assert row.suggestions[0].after == "Platform Engineer | Acme"
    only = t.apply_suggestions(suggested, F.array(F.lit("skills"))).first().proposed
    assert only.skills == ["Spark", "CI/CD", "dbt", "Kafka"] and only.headline == "Data Engineer"
    letter = t.letters(pair).first().letter
    assert "Senior Platform Engineer position at Acme" in letter and "Ada Sample" in letter


def test_upload_rules(spark):
    rows = spark.createDataFrame(
        [("a/b:c.pdf", "application/pdf; q=1", bytearray(b"x")), ("e.pdf", "application/pdf", bytearray()),
         ("n.txt", "text/plain", bytearray(b"x"))],
        "filename string, mime_type string, content binary",
    )
    good, bad = uploads.register(rows)
    assert [(r.title, r.extension) for r in good.collect()] == [("b_c.pdf", "pdf")]
    assert {r.reason for r in bad.collect()} == {"empty_file", "unsupported_type"}


def test_grounded_roles_derives_its_texts_once(spark):
    """The text stays beside what is read from it; both were derived, and joined, before. Lines are bound outside of the needles."""
    from __spark_entry__ import queries

    plan = queries()["grounded_roles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and sum("Relation" in x and "l_partkey" in x for x in plan.splitlines()) == 1
