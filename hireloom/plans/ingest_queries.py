"""Ingest queries: provider mapping, dedupe, upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom import schemas
from hireloom.functions.classify import remote_type_from_location, remote_type_from_text
from hireloom.functions.text import company_key
from hireloom.operators import filters as f
from hireloom.operators import ingest as i
from hireloom.operators.ordered import latest, neighbour
from hireloom.plans import oracle as o
from hireloom.plans.registry import query
from hireloom.sources import bindings as b
from hireloom.sources import providers as p

OBS = o.with_(o.OBSERVATIONS)
CUT = "2000-01-01"


def _observations(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Order lines with the full set of observation columns."""
    null = F.lit(None)
    return (
        b.observations(spark, sf_dir, parts)
        .withColumn("requirements", F.struct("skills"))
        .withColumn("compensation", F.struct(F.col("pay_min").alias("min")))
        .withColumn("remote_type", remote_type_from_text(F.col("location"), null.cast("string")))
        .withColumn(
            "canonical_url",
            F.concat(F.lit("https://example.com/jobs/"), F.col("external_id")),
        )
        .withColumn("posted_at", F.when(F.col("position") % 3 == 0, F.col("retrieved_at")))
        .withColumn("company_industry", null.cast("string"))
    )


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting table after ingesting everything seen before the cut."""
    early = i.dedupe(_observations(spark, sf_dir).filter(F.col("retrieved_at") < CUT))
    stamp = F.lit(CUT).cast("timestamp")
    return early.select(
        *i.KEY,
        i.posting_key().alias("posting_id"),
        company_key(F.col("company_name")).alias("company_key"),
        *i.POSTING_FIELDS,
        F.lit("eligible").alias("status"),
        F.coalesce("posted_at", stamp).alias("posted_at"),
        stamp.alias("created_at"),
    )


@query("provider_listing", """SELECT 'remotive' AS provider,
  CASE WHEN p_partkey % 5 = 0 THEN 'https://example.com/' || p_partkey ELSE p_partkey::VARCHAR END
    AS external_id,
  CASE WHEN p_size = 1 THEN 'Untitled role' ELSE p_name END AS title, p_brand AS company_name,
  CASE WHEN p_size % 2 = 0 THEN 'Remote' ELSE p_type END AS location, 'remote' AS remote_type,
  strftime(TIMESTAMP '2024-01-01' + to_days(p_size), '%Y-%m-%d %H:%M:%S') AS posted,
  CASE WHEN p_size % 7 <> 0 THEN '$' || p_size END AS salary,
  concat_ws(',', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS skills
FROM part""")
def provider_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as listing JSON and read back through the listing reader."""
    size, key = F.col("p_size"), F.col("p_partkey")
    posted = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), size), "yyyy-MM-dd")
    item = F.struct(
        F.when(key % 5 != 0, key.cast("string")).alias("id"),
        F.concat(F.lit("https://example.com/"), key.cast("string")).alias("url"),
        F.when(size != 1, F.col("p_name")).alias("title"),
        F.col("p_brand").alias("company_name"),
        F.split("p_name", " ").alias("tags"),
        F.when(size % 2 == 0, "").otherwise(F.col("p_type")).alias(
            "candidate_required_location"
        ),
        F.concat(posted, F.when(size % 3 == 0, "T00:00:00Z").otherwise("T00:00:00")).alias(
            "publication_date"
        ),
        F.when(size % 7 != 0, F.concat(F.lit("$"), size.cast("string"))).alias("salary"),
    )
    raw = b.table(spark, sf_dir, "part").select(
        F.to_json(F.struct(F.array(item).alias("jobs"))).alias("body")
    )
    items = raw.select(F.explode(F.from_json("body", schemas.LISTING)["jobs"]).alias("job"))
    return p.from_listing(items).select(
        "provider", "external_id", "title", "company_name", "location", "remote_type",
        F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted"),
        F.col("compensation.salary").alias("salary"),
        F.array_join("requirements.skills", ",").alias("skills"),
    )


def _search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = b.postings(spark, sf_dir)
    return posted.select(
        F.when(F.col("posting_id") % 4 != 0, F.col("posting_id").cast("string")).alias("id"),
        "title",
        F.when(F.col("posting_id") % 6 != 0, F.col("skills")[2]).alias("company"),
        "location",
        F.col("canonical_url").alias("url"),
        F.col("skills").alias("skills_required"),
        F.lit("").alias("salary"),
        F.col("posted_at").alias("found_at"),
        F.lit(7).alias("match_score"),
    )


@query("provider_search_results", f"""{o.with_(o.POSTINGS)}
SELECT coalesce(CASE WHEN posting_id % 4 <> 0 THEN posting_id::VARCHAR END,
    CASE WHEN posting_id % 6 <> 0 THEN skills[3] ELSE 'Unknown company' END || ':' || title)
    AS external_id,
  CASE WHEN posting_id % 6 <> 0 THEN skills[3] ELSE 'Unknown company' END AS company_name, location,
  CASE WHEN location IS NULL THEN NULL WHEN lower(location) LIKE '%hybrid%' THEN 'hybrid'
    WHEN lower(location) LIKE '%remote%' THEN 'remote' ELSE 'onsite' END AS remote_type,
  'naukri' AS source FROM postings""")
def provider_search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.from_search_results(_search_rows(spark, sf_dir)).select(
        "external_id", "company_name", "location", "remote_type",
        F.col("requirements.source").alias("source"),
    )


@query("seed_search", f"""{o.with_(o.POSTINGS)} SELECT posting_id FROM postings
WHERE contains(lower(title), 'brand#1') OR contains(lower(description), 'brand#1')
  OR contains(lower(array_to_string(skills, '|')), 'brand#1')""")
def seed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = (
        b.postings(spark, sf_dir)
        .withColumn("requirements", F.struct("skills"))
        .withColumn("company_name", F.col("provider"))
    )
    return p.search_seed(seed, "Brand#1").select("posting_id")


@query("remote_type_rules", f"""{o.with_(o.POSTINGS)} SELECT posting_id,
  CASE WHEN lower(concat_ws(' ', location, description)) LIKE '%remote%' THEN 'remote'
    WHEN lower(concat_ws(' ', location, description)) LIKE '%hybrid%' THEN 'hybrid'
    WHEN location IS NOT NULL THEN 'onsite' END AS from_text,
  CASE WHEN location IS NULL THEN NULL WHEN lower(location) LIKE '%hybrid%' THEN 'hybrid'
    WHEN regexp_matches(lower(location), 'remote|work from home|wfh') THEN 'remote'
    ELSE 'onsite' END AS from_location FROM postings""")
def remote_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.postings(spark, sf_dir).select(
        "posting_id",
        remote_type_from_text(F.col("location"), F.col("description")).alias("from_text"),
        remote_type_from_location(F.col("location")).alias("from_location"),
    )


@query("provider_union", """SELECT provider, count(*) AS fetched,
  CASE WHEN provider = 'linkedin' THEN 'linkedin returned no jobs for these filters.'
    ELSE provider || ' fetched ' || count(*) || ' jobs.' END AS warning
FROM (SELECT 'remotive' AS provider FROM part UNION ALL SELECT 'naukri' FROM part
  UNION ALL SELECT 'demo' FROM part) GROUP BY 1
UNION ALL SELECT 'linkedin', 0, 'linkedin returned no jobs for these filters.'""")
def provider_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    searched = p.from_search_results(_search_rows(spark, sf_dir))
    parts = [searched.withColumn("provider", F.lit(n)) for n in ("remotive", "demo")]
    merged = p.union_providers(searched, *parts)
    return p.provider_report(merged, ["remotive", "naukri", "demo", "linkedin"])


FIRST = """first_seen AS (
  SELECT * FROM observations QUALIFY row_number() OVER (
    PARTITION BY provider, external_id ORDER BY provider_rank, position) = 1)"""


@query("observation_dedupe", f"""{OBS}, {FIRST}
SELECT provider, external_id, title, company_name, position FROM first_seen""")
def observation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.dedupe(_observations(spark, sf_dir)).select(
        "provider", "external_id", "title", "company_name", "position"
    )


@query("discover_first", f"""{OBS}, found AS (
  SELECT * FROM observations WHERE contains(lower(concat_ws(' ', title, description, location)), 'ring')
    AND (contains(lower(concat_ws(' ', title, description, array_to_string(skills, ' '))), 'brand#7'))),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (
    PARTITION BY provider, external_id ORDER BY provider_rank, position) = 1)
SELECT provider, external_id, position FROM firsts ORDER BY provider_rank, position LIMIT 20""")
def discover_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = f.SearchFilters(query="ring", skills=["brand#7"])
    return i.discover(_observations(spark, sf_dir), filters, limit=20).select(
        "provider", "external_id", "position"
    )


@query("company_upsert", f"""{OBS},
old AS (SELECT s_suppkey, 'supplier ' || s_suppkey AS company_key, 'Old ' || s_suppkey AS name
  FROM supplier WHERE s_suppkey % 2 = 0),
new AS (SELECT lower(replace(company_name, '#', '')) AS company_key,
    arg_min(company_name, {{'r': provider_rank, 'p': position}}) AS name,
    arg_min(company_website, {{'r': provider_rank, 'p': position}})
      FILTER (WHERE company_website IS NOT NULL) AS website
  FROM observations GROUP BY 1)
SELECT company_key, coalesce(old.name, new.name) AS name, website,
  CASE WHEN old.name IS NULL THEN 'insert' WHEN website IS NOT NULL THEN 'update' ELSE 'keep' END
    AS action
FROM old FULL JOIN new USING (company_key)""")
def company_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    existing = b.table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 2 == 0).select(
        F.concat(F.lit("supplier "), key).alias("company_key"),
        F.concat(F.lit("Old "), key).alias("name"),
        F.lit(None).cast("string").alias("website"),
        F.lit(None).cast("string").alias("industry"),
    )
    return i.upsert_companies(existing, _observations(spark, sf_dir)).drop("industry")


UPSERT = f"""{OBS},
marked AS (SELECT *, CASE WHEN position % 3 = 0 THEN retrieved_at END AS posted FROM observations),
old AS (SELECT provider, external_id, title, company_name,
    coalesce(posted, TIMESTAMP '{CUT}') AS posted FROM marked WHERE retrieved_at < '{CUT}'
  QUALIFY row_number() OVER (PARTITION BY provider, external_id ORDER BY provider_rank, position) = 1),
new AS (SELECT provider, external_id, title, company_name, posted FROM marked
  WHERE retrieved_at >= '{CUT}'
  QUALIFY row_number() OVER (PARTITION BY provider, external_id ORDER BY provider_rank, position) = 1),
upserted AS (
  SELECT provider, external_id,
    lower(replace(coalesce(new.company_name, old.company_name), '#', '')) AS company_key,
    CASE WHEN new.title IS NULL THEN 'eligible' ELSE 'normalized' END AS status,
    strftime(coalesce(new.posted, old.posted,
      CASE WHEN old.title IS NULL THEN TIMESTAMP '2003-01-01' END), '%Y-%m-%d') AS posted,
    CASE WHEN old.title IS NULL THEN 'insert' WHEN new.title IS NULL THEN 'keep' ELSE 'update' END
      AS action
  FROM old FULL JOIN new USING (provider, external_id))"""


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = i.dedupe(_observations(spark, sf_dir).filter(F.col("retrieved_at") >= CUT))
    as_of = F.lit("2003-01-01").cast("timestamp")
    return i.upsert_postings(_existing(spark, sf_dir), batch, as_of)


@query("posting_upsert", f"{UPSERT} SELECT * FROM upserted")
def posting_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).select(
        "provider", "external_id", "company_key", "status",
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "action",
    )


@query("posting_upsert_actions", f"{UPSERT} SELECT action, count(*) AS n FROM upserted GROUP BY 1")
def posting_upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.counters(_upserted(spark, sf_dir))


@query("source_upsert", f"""{UPSERT} SELECT provider, external_id,
  CASE WHEN action = 'keep' THEN '{CUT}' ELSE '2003-01-01' END AS retrieved FROM upserted""")
def source_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumn("source_url", F.col("canonical_url")).withColumn(
        "raw_payload", F.to_json(F.struct("title", "skills"))
    )
    early = i.dedupe(rows.filter(F.col("retrieved_at") < CUT)).select(
        *i.KEY, i.posting_key().alias("posting_id"),
        F.lit(CUT).cast("timestamp").alias("retrieved_at"), "source_url", "raw_payload",
    )
    batch = i.dedupe(rows.filter(F.col("retrieved_at") >= CUT))
    as_of = F.lit("2003-01-01").cast("timestamp")
    return i.upsert_sources(early, batch, as_of).select(
        "provider", "external_id", F.date_format("retrieved_at", "yyyy-MM-dd").alias("retrieved")
    )


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per observation of a source; sources shared by three flags differ."""
    rows = _observations(spark, sf_dir)
    return i.snapshots(rows, F.col("retrieved_at")).withColumn(
        "external_id", F.col("snapshot.external_id")
    )


@query("snapshot_changes", f"""{OBS}, s AS (
  SELECT provider, external_id, retrieved_at, position, pay_min, company_name, location,
    lag(struct_pack(a := pay_min, b := company_name, c := coalesce(location, '-'))) OVER (
      PARTITION BY provider, external_id ORDER BY retrieved_at, position) AS prev
  FROM observations)
SELECT provider, external_id, position,
  CASE WHEN prev IS NULL THEN 'first'
    WHEN prev = struct_pack(a := pay_min, b := company_name, c := coalesce(location, '-')) THEN 'same'
    ELSE 'changed' END AS change FROM s""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir)
    fields = [c for c in i.SNAPSHOT_FIELDS if c in rows.columns]
    from hireloom.functions.text import checksum

    # As bytes the checksum takes half the room in every shuffle.
    marked = rows.select(
        *i.KEY, "retrieved_at", "position", F.unhex(checksum(*fields)).alias("checksum")
    )
    linked = neighbour(
        marked, i.KEY, ["retrieved_at", "position"], F.col("checksum"), "before",
        F.date_trunc("month", "retrieved_at"),
    )
    change = (
        F.when(F.col("before").isNull(), "first")
        .when(F.col("before") == F.col("checksum"), "same")
        .otherwise("changed")
    )
    return linked.select("provider", "external_id", "position", change.alias("change"))


@query("snapshot_latest", f"""{OBS}
SELECT provider, external_id, position FROM observations QUALIFY row_number() OVER (
  PARTITION BY provider, external_id ORDER BY retrieved_at DESC, position DESC) = 1""")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).select(*i.KEY, "retrieved_at", "position", "title")
    return latest(rows, i.KEY, ["retrieved_at", "position"]).select(*i.KEY, "position")


@query("snapshot_rows", f"""{OBS}
SELECT provider, count(*) AS snapshots, count(DISTINCT external_id) AS postings
FROM observations GROUP BY 1""")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _snapshots(spark, sf_dir)
        .groupBy(F.col("snapshot.provider").alias("provider"))
        .agg(F.count("*").alias("snapshots"), F.count_distinct("posting_id").alias("postings"))
    )


@query("merged_postings", f"""{OBS}, {FIRST}, g AS (
  SELECT provider, external_id, provider_rank, provider || ':' || external_id AS posting_id,
    title, company_name, coalesce(lower(location), '') AS place FROM first_seen)
SELECT posting_id, first_value(posting_id) OVER w AS canonical_id, count(*) OVER (
    PARTITION BY title, company_name, place) AS copies FROM g
WINDOW w AS (PARTITION BY title, company_name, place ORDER BY provider_rank, posting_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = i.dedupe(_observations(spark, sf_dir)).withColumn(
        "posting_id", F.concat_ws(":", *i.KEY)
    )
    return i.merge_duplicates(rows).select("posting_id", "canonical_id", "copies")


@query("exact_duplicates", """WITH d AS (SELECT doc_id, source, text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY source, k, alone) AS canonical_id,
  count(*) OVER (PARTITION BY source, k, alone) AS copies
FROM (SELECT *, CASE WHEN k = '' THEN doc_id END AS alone FROM (SELECT *,
  coalesce(trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), '') AS k FROM d))""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("posting_id"),
        F.col("source").alias("company_name"),
        F.col("text").alias("title"),
        F.lit(None).cast("string").alias("location"),
        F.lit(0).alias("provider_rank"),
    )
    return i.merge_duplicates(rows).select(
        F.col("posting_id").alias("doc_id"), "canonical_id", "copies"
    )


@query("company_keys", """SELECT s_suppkey,
  coalesce(nullif(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ''), 'unknown')
    AS company_key FROM supplier""")
def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "supplier").select(
        "s_suppkey", company_key(F.col("s_name")).alias("company_key")
    )
