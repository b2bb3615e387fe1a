"""Catalog queries: filters, order, pages, company join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.functions.classify import experience_level, min_years
from hireloom.functions.text import company_key, tokens
from hireloom.operators import catalog as c
from hireloom.operators import filters as f
from hireloom.operators.text_index import TextIndex
from hireloom.plans import oracle as o
from hireloom.plans.registry import QUERIES, query
from hireloom.session import new_path
from hireloom.sources import bindings as b

P = o.with_(o.POSTINGS)
BLOB = "lower(concat_ws(' ', title, nullif(description, '')))"
LEVEL = o.level(BLOB)
YEARS = (
    f"coalesce({o.years_of(BLOB)}, CASE {LEVEL} WHEN 'junior' THEN 0 WHEN 'mid' THEN 3 ELSE 5 END)"
)
OPEN = "status IN ('discovered', 'normalized', 'eligible')"


def _filter_query(name: str, predicate, condition: str) -> None:
    @query(name, f"{P} SELECT posting_id, title, location FROM postings WHERE {condition}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return b.postings(spark, sf_dir).filter(predicate()).select(
            "posting_id", "title", "location"
        )


_filter_query(
    "filter_free_text", lambda: f.free_text("Small Ring"),
    "contains(lower(concat_ws(' ', title, description, location)), 'small ring')",
)
_filter_query(
    "filter_catalog_text", lambda: f.catalog_text("BLUE"),
    "title ILIKE '%blue%' OR description ILIKE '%blue%' OR coalesce(location, '') ILIKE '%blue%'",
)
_filter_query(
    "filter_catalog_wildcard", lambda: f.catalog_text("s_all%ring", wildcards=True),
    "title ILIKE '%s_all%ring%' OR description ILIKE '%s_all%ring%' "
    "OR coalesce(location, '') ILIKE '%s_all%ring%'",
)
_filter_query(
    "filter_location", lambda: f.location_has("nation_7"),
    "contains(lower(coalesce(location, '')), 'nation_7')",
)
_filter_query(
    "filter_country", lambda: f.country_in("India"),
    "len(list_filter(['india','bengaluru','bangalore','hyderabad','pune','mumbai','delhi'], "
    "lambda n: contains(lower(concat_ws(' ', location, description)), n))) > 0",
)
_filter_query(
    "filter_country_words", lambda: f.country_in("us", word_boundary=True),
    "regexp_matches(lower(concat_ws(' ', location, description)), "
    "'\\b(us|usa|united states|america|americas)\\b')",
)
_filter_query(
    "filter_remote_discover", lambda: f.remote_is("remote", "discover"),
    "coalesce(remote_type, '') IN ('', 'remote', 'worldwide')",
)
_filter_query(
    "filter_remote_catalog", lambda: f.remote_is("hybrid", "catalog"), "remote_type = 'hybrid'"
)
_filter_query(
    "filter_any_skill", lambda: f.any_skill(["Gizmo", "brand#7"]),
    "contains(lower(concat_ws(' ', title, description, array_to_string(skills, ' '))), 'gizmo') OR "
    "contains(lower(concat_ws(' ', title, description, array_to_string(skills, ' '))), 'brand#7')",
)
_filter_query(
    "filter_level", lambda: f.level_is("senior"), f"provider = 'naukri' OR {LEVEL} = 'senior'"
)
_filter_query(
    "filter_min_years", lambda: f.years_at_least(3),
    f"provider = 'naukri' OR NOT ({YEARS} < 3 AND {LEVEL} = 'junior')",
)
_filter_query("filter_open_status", f.open_posting, OPEN)


INDEXED = {
    "index_free_text": ("filter_free_text", lambda index: index.free_text("Small Ring")),
    "index_catalog_text": ("filter_catalog_text", lambda index: index.catalog_text("BLUE")),
    "index_catalog_wildcard": ("filter_catalog_wildcard", lambda index: index.catalog_text("s_all%ring", wildcards=True)),
}


def _index_query(name: str, scanned: str, find) -> None:
    """The rows of a scanning query, by the text index of all postings."""

    @query(name, QUERIES[scanned].sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = TextIndex(spark, new_path(spark, "text-index"), 16).build(b.spread(b.postings(spark, sf_dir)))
        return find(index).select("posting_id", "title", "location")


for _name, (_scanned, _find) in INDEXED.items():
    _index_query(_name, _scanned, _find)


@query("filter_source_tag", f"""{P}
SELECT 'level' AS kind, posting_id FROM postings WHERE provider = 'naukri' OR posting_id % 4 = 0
  OR ({LEVEL} = 'senior' AND NOT ({YEARS} < 6 AND {LEVEL} = 'junior'))
UNION ALL
SELECT 'years', posting_id FROM postings WHERE posting_id % 4 = 0 OR NOT ({YEARS} < 3 AND {LEVEL} = 'junior')
UNION ALL
SELECT 'catalog', posting_id FROM postings WHERE posting_id % 4 = 0 OR {LEVEL} = 'mid'""")
def filter_source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings that carry the tag of a provider which filters by level, whoever delivered them."""
    rows = b.postings(spark, sf_dir).withColumn("requirements", F.struct(F.when(F.col("posting_id") % 4 == 0, "naukri").alias("source")))
    source = F.col("requirements.source")
    searches = {
        "level": (f.SearchFilters(experience_level="Senior", min_experience_years=6), "discover"),
        "years": (f.SearchFilters(min_experience_years=3), "discover"),
        "catalog": (f.SearchFilters(experience_level="mid"), "catalog"),
    }
    found = [rows.filter(f.matches(s, mode, source=source)).select(F.lit(kind).alias("kind"), "posting_id") for kind, (s, mode) in searches.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("seniority_class", f"""{P} SELECT posting_id, {LEVEL} AS level, {YEARS}::INT AS min_years
FROM postings""")
def seniority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.postings(spark, sf_dir).select(
        "posting_id",
        experience_level(F.col("title"), F.col("description")).alias("level"),
        min_years(F.col("title"), F.col("description")).alias("min_years"),
    )


DOC_LEVEL = o.level("lower(text)")


@query("document_levels", f"""SELECT source, {DOC_LEVEL} AS level, count(*) AS n
FROM documents GROUP BY ALL""")
def document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    level = experience_level(F.lit(None).cast("string"), text).alias("level")
    return (
        b.table(spark, sf_dir, "documents")
        .select("source", level)
        .groupBy("source", "level")
        .agg(F.count("*").alias("n"))
    )


@query("token_stats", f"""WITH t AS (
  SELECT doc_id, lang, unnest({o.tokens("text")}) AS token FROM documents)
SELECT lang, token, count(*) AS n_docs FROM t GROUP BY ALL""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language and token; tokens are distinct inside a document."""
    return (
        b.table(spark, sf_dir, "documents")
        .select("lang", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("lang", "token")
        .agg(F.count("*").alias("n_docs"))
    )


SEARCH = f.SearchFilters(query="r", remote_type="remote", skills=["gizmo", "ring", "bolt"])
SEARCH_SQL = f"""{P}, found AS (
  SELECT * FROM postings WHERE {OPEN} AND (title ILIKE '%r%' OR description ILIKE '%r%'
      OR coalesce(location, '') ILIKE '%r%') AND remote_type = 'remote'
    AND (contains({BLOB[:-1]} || ' ' || array_to_string(skills, ' ')), 'gizmo')
      OR contains({BLOB[:-1]} || ' ' || array_to_string(skills, ' ')), 'ring')
      OR contains({BLOB[:-1]} || ' ' || array_to_string(skills, ' ')), 'bolt')))"""


@query("catalog_search", f"{SEARCH_SQL} SELECT posting_id, title FROM found")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.search(b.postings(spark, sf_dir), SEARCH).select("posting_id", "title")


@query("catalog_page", f"""{SEARCH_SQL}
SELECT posting_id, title, strftime(posted_at, '%Y-%m-%d') AS posted,
  (SELECT count(*) FROM found) AS total
FROM found ORDER BY posted_at DESC NULLS LAST, created_at DESC, posting_id LIMIT 20 OFFSET 10""")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.search_page(b.postings(spark, sf_dir), SEARCH, limit=20, offset=10).select(
        "posting_id", "title", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), "total"
    )


PAGE = 20
ORDERED = f"""{P}, ranked AS (SELECT *, row_number() OVER (ORDER BY posted_at DESC NULLS LAST, created_at DESC, posting_id) AS rank,
  count(*) OVER () AS total FROM postings WHERE {OPEN})"""


@query("catalog_deep_page", f"""{ORDERED}
SELECT rank, posting_id, strftime(posted_at, '%Y-%m-%d') AS posted FROM ranked
WHERE rank > total * 9 // 10 AND rank <= total * 9 // 10 + {PAGE}""")
def catalog_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of all open postings, nine tenths of the way through."""
    table = c.RankTable(b.postings(spark, sf_dir).filter(f.open_posting()))
    return table.page(PAGE, table.total * 9 // 10).select(
        "rank", "posting_id", F.date_format("posted_at", "yyyy-MM-dd").alias("posted")
    )


@query("catalog_next_page", f"""{ORDERED}
SELECT posting_id, strftime(posted_at, '%Y-%m-%d') AS posted FROM ranked WHERE rank > 2 * {PAGE} AND rank <= 3 * {PAGE}""")
def catalog_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page, reached by the cursors of the two before it."""
    found, cursor = b.postings(spark, sf_dir).filter(f.open_posting()), None
    for _ in range(2):
        last = c.next_page(found, cursor, PAGE).collect()[-1]
        cursor = (last["posted_at"], last["created_at"], last["posting_id"])
    return c.next_page(found, cursor, PAGE).select("posting_id", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@query("posting_company", f"""{o.with_(o.POSTINGS, o.COMPANIES)}
SELECT posting_id, title, company_name, market FROM postings LEFT JOIN companies USING (company_id)""")
def posting_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.with_company(b.postings(spark, sf_dir), b.companies(spark, sf_dir)).select(
        "posting_id", "title", "company_name", "market"
    )


@query("expired_postings", f"""{P}
SELECT CASE WHEN posted_at + INTERVAL 20 DAY < TIMESTAMP '2024-02-10' THEN 'expired'
  ELSE status END AS status, count(*) AS n FROM postings GROUP BY 1""")
def expired_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = b.postings(spark, sf_dir).withColumn(
        "expires_at", F.col("posted_at") + F.expr("INTERVAL 20 DAYS")
    )
    return c.expire(dated, "2024-02-10").groupBy("status").agg(F.count("*").alias("n"))


@query("eligible_postings", f"""{o.with_(o.POSTINGS, o.COMPANIES)},
cand AS (
  SELECT DISTINCT o_custkey AS profile_id, l_partkey AS posting_id
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT profile_id, posting_id FROM cand JOIN postings p USING (posting_id)
JOIN customer ON c_custkey = profile_id LEFT JOIN companies c ON c.company_id = p.company_id
WHERE coalesce(regexp_replace(lower(company_name), '[^a-z0-9]+', ' ', 'g'), 'unknown')
    <> 'supplier ' || lpad((c_nationkey % 10)::VARCHAR, 9, '0')
  AND (c_nationkey % 2 = 0 OR contains(lower(coalesce(location, '')), 'remote'))
  AND (c_nationkey % 3 <> 0 OR remote_type = 'remote')
  AND (c_nationkey % 5 <> 0 OR coalesce(pay_min >= 1000, true))""")
def eligible_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = (
        b.table(spark, sf_dir, "orders")
        .join(b.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("profile_id"), F.col("l_partkey").alias("posting_id"))
        .distinct()
    )
    posted = c.with_company(b.postings(spark, sf_dir), b.companies(spark, sf_dir))
    rows = candidates.join(posted, "posting_id").withColumn(
        "company_key", company_key(F.col("company_name"))
    )
    nation = F.col("c_nationkey")
    preferences = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        F.array(
            F.concat(F.lit("supplier "), F.lpad((nation % 10).cast("string"), 9, "0"))
        ).alias("blocked_companies"),
        F.when(nation % 2 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("Remote")))
        .alias("locations"),
        F.when(nation % 3 == 0, "remote").alias("remote_policy"),
        F.when(nation % 5 == 0, 1000.0).alias("salary_floor"),
    )
    return c.eligible(rows, preferences).select("profile_id", "posting_id")
