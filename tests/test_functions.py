from pyspark.sql import functions as F

from hireloom.functions import classify, contact, dates, html, skills, sql, text
from hireloom.sources import providers


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


def test_keys(spark):
    assert one(spark, "  Acme,  Inc. ", text.company_key) == "acme inc"
    assert one(spark, "???", text.company_key) == "unknown"
    assert one(spark, " Big\t Data ", text.skill_key) == "big data"


def test_tokens_keep_symbols_and_drop_stop_words(spark):
    got = one(spark, "The team uses C++, node.js and C# at work. a", text.tokens)
    assert got == ["uses", "c++", "node.js", "c#", "work."]
    assert one(spark, None, text.tokens) == []


def test_levels(spark):
    none = F.lit(None).cast("string")

    def level(t):
        return one(spark, t, lambda c: classify.experience_level(c, none))

    assert level("Senior Data Engineer") == "senior"
    assert level("Sr. Analyst") == "senior"
    assert level("Senior intern") == "senior"
    assert level("Entry-level clerk") == "junior"
    assert level("Mid level developer") == "mid"
    assert level("Engineer, 3-5 years") == "mid"
    assert level("Engineer 7+ years") == "senior"
    assert level("Engineer 1 year") == "junior"
    assert level("Engineer") == "mid"
    assert level("mislead Élead") == "mid"
    years = one(spark, "Engineer, 99999999999 years", lambda c: classify.min_years(c, none))
    assert years == 5


def test_remote_rules_differ_in_order(spark):
    none = F.lit(None).cast("string")
    both = "Hybrid or remote"
    assert one(spark, both, lambda c: classify.remote_type_from_text(c, none)) == "remote"
    assert one(spark, both, classify.remote_type_from_location) == "hybrid"
    assert one(spark, "Pune", classify.remote_type_from_location) == "onsite"
    assert one(spark, None, classify.remote_type_from_location) is None


def test_inferred_skills_prefer_longer_terms(spark):
    got = one(spark, "JavaScript, PostgreSQL and Google Cloud Platform; Go", skills.inferred_skills)
    assert got == ["google cloud platform", "javascript", "postgresql"]
    assert one(spark, "ci/cd", skills.display_skill) == "CI/CD"
    assert one(spark, "system design", skills.display_skill) == "System Design"
    assert one(spark, "a/b test", text.title_case) == "A/B Test"


def test_variant_skills(spark):
    got = one(
        spark, '["Spark ", {"name": "SQL"}, {"skill": "dbt"}, 3, {"x": 1}, ""]',
        lambda c: skills.skills_from_variant(F.parse_json(c)),
    )
    assert got == ["Spark", "SQL", "dbt"]


def test_html(spark):
    assert one(spark, "<p>A&amp;B<br/>c</p> <b>d</b>&#39;", html.strip_html) == "A&B\nc\n d '"
    assert one(spark, "<p> </p>", html.strip_html) is None
    url = "https://www.linkedin.com/jobs/view/4252026496/?trk=x"
    assert one(spark, url, html.job_id) == "4252026496"
    assert one(spark, url, html.job_url) == "https://www.linkedin.com/jobs/view/4252026496/"
    assert one(spark, "https://x.example/s?currentJobId=1234567&y", html.job_id) == "1234567"
    assert one(spark, " 1234567 ", html.job_id) == "1234567"
    assert one(spark, "https://x.example/jobs/1", html.job_id) is None


def test_iso_timestamp(spark):
    def ts(value):
        got = one(spark, value, lambda c: F.date_format(dates.iso_timestamp(c), "yyyy-MM-dd HH:mm"))
        return got

    assert ts("2024-01-15T12:00:00Z") == "2024-01-15 12:00"
    assert ts("2024-01-15T12:00:00+05:30") == "2024-01-15 06:30"
    assert ts("2024-01-15") == "2024-01-15 00:00"
    assert ts("soon") is None
    assert ts("2024-13-45") is None


def test_date_range(spark):
    got = one(spark, "Engineer | Acme, Pune FEB 2024 – PRESENT", dates.date_range)
    assert (got.start, got.end, got.is_current, got.rest) == (
        "FEB 2024", None, True, "Engineer | Acme, Pune",
    )
    got = one(spark, "2019 - Mar 2021 Analyst", dates.date_range)
    assert (got.start, got.end, got.is_current, got.rest) == ("2019", "Mar 2021", False, "Analyst")
    assert str(one(spark, "September 2024", dates.parsed_date)) == "2024-09-01"
    assert one(spark, "Present", dates.parsed_date) is None


def test_contact(spark):
    body = "Reach me: ann.lee@mail.example.com or +91 98765 43210, https://a.example www.b.example"
    assert one(spark, body, contact.email) == "ann.lee@mail.example.com"
    assert one(spark, body, contact.phone) == "+91 98765 43210"
    assert one(spark, body, contact.links) == ["https://a.example", "www.b.example"]


def test_digits_of_addresses_and_links_are_no_phone(spark):
    body = "c100000@mail.example.com | github.com/a1234567 | https://x.example/9876543210 | +91 98765 43210"
    assert one(spark, body, contact.phone) == "+91 98765 43210"
    assert one(spark, "c1000000015@mail.example.com", contact.phone) is None


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT company_key('Acme, Inc.'), skill_key(' Big  Data'), text_tokens('The C++ dev')"
    ).first()
    assert tuple(row) == ("acme inc", "big data", ["c++", "dev"])


def test_listing_file(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text(
        '{"jobs": [{"id": 7, "title": "", "url": "u7", "tags": ["SQL"], "salary": "9k",'
        ' "publication_date": "2024-01-15T12:00:00"}, {"url": "u8", "title": "Dev"}]}'
    )
    rows = {r.external_id: r for r in providers.read_listing(spark, str(path)).collect()}
    assert set(rows) == {"7", "u8"}
    assert rows["7"].title == "Untitled role" and rows["7"].compensation.salary == "9k"
    assert rows["u8"].location == "Remote" and rows["u8"].requirements.skills == []


def test_text_index_equals_the_scan_and_reads_few_lists(spark, tmp_path):
    from hireloom.operators import filters as f
    from hireloom.operators.text_index import TextIndex, pieces_of

    rows = [(i, f"posting {i}", "common words " + ("needle in hay" if i % 50 == 0 else "nothing else") * (1 + i % 3), "Pune" if i % 7 == 0 else None) for i in range(300)]
    rows += [(900, "Größe und Maß", None, ""), (901, None, None, None), (902, "ab", "c", "d"), (903, "50%_off", "back\\slash", "x"), (904, "x" * 20_000, "", None)]
    frame = spark.createDataFrame(rows, "posting_id long, title string, description string, location string")
    index = TextIndex(spark, str(tmp_path / "index"), 8).build(frame)
    ids = lambda df: sorted(r.posting_id for r in df.select("posting_id").collect())
    for q in ("needle", "NEEDLE in", "words needle", "17 common", "größe", "ab", "b c d", "zzz", "posting 299", "", "xxxx", "hay Pune", "back\\slash"):
        assert ids(index.free_text(q)) == ids(frame.filter(f.free_text(q))), q
        assert ids(index.catalog_text(q)) == ids(frame.filter(f.catalog_text(q))), q
    for q in ("%needle%hay", "p_sting 2_", "50%", "n__dle", "%"):
        assert ids(index.catalog_text(q, wildcards=True)) == ids(frame.filter(f.catalog_text(q, wildcards=True))), q
    lists = index._rows("lists", ["nee"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "PushedFilters: [In(piece" in plan or "EqualTo(piece" in plan
    assert index.candidates(["needle"]).count() == 6 and index.candidates(["ab"]) is None
    assert spark.createDataFrame([("abab",), ("ab",), (None,)], "t string").select(pieces_of(F.col("t"))).collect()[0][0] == ["aba", "bab"]


def test_strip_equals_the_unicode_pattern(spark):
    """Trimming by characters takes off what the pattern for white space took, for every character of the first plane."""
    code = F.lpad(F.hex("id"), 4, "0")
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(code), "UTF-16BE").alias("c"))
    rows = chars.select(F.explode(F.array("c", F.concat("c", F.lit("a b"), "c", F.lit("\n")))).alias("t"))
    assert rows.where(text.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


def test_date_range_binds_its_text(spark):
    """A text that takes work is worked out once, not for every pattern."""
    ranged = spark.range(1).select(dates.date_range(F.upper(F.concat(F.lit("Lead "), F.col("id").cast("string"), F.lit(" Jan 2020 - Present")))).alias("d"))
    assert ranged.select("d.start", "d.is_current", "d.rest").first() == ("JAN 2020", True, "LEAD 0")
    assert ranged._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    null = F.lit(None).cast("string")
    assert spark.range(1).select(dates.date_range(null).alias("d")).select("d.*").first() == (None, None, False, None)
