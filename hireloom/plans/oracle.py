"""SQL views of the bound tables, written apart from the Spark code that builds them."""

POSTINGS = """
postings AS (
  SELECT p_partkey AS posting_id,
    CASE p_partkey % 3 WHEN 0 THEN 'remotive' WHEN 1 THEN 'naukri' ELSE 'demo' END AS provider,
    p_partkey % 100 AS company_id,
    CASE p_size % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Mid-level ' ELSE '' END
      || p_name AS title,
    'Own ' || lower(p_type) || ' parts for ' || p_brand ||
      CASE WHEN p_size % 4 = 0 THEN '. Needs ' || (p_size % 12) || '+ years of practice.'
           ELSE '. Ships to many markets.' END AS description,
    CASE p_size % 6 WHEN 0 THEN 'Remote - Worldwide' WHEN 1 THEN 'Remote - US'
      WHEN 2 THEN 'Bengaluru, India' WHEN 3 THEN 'Hybrid - NATION_' || (p_partkey % 25)
      WHEN 4 THEN 'NATION_' || (p_partkey % 25) END AS location,
    CASE p_size % 6 WHEN 0 THEN 'remote' WHEN 1 THEN 'remote' WHEN 2 THEN 'hybrid'
      WHEN 3 THEN 'hybrid' WHEN 4 THEN 'onsite' END AS remote_type,
    [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, lower(p_type)] AS skills,
    CASE p_partkey % 10 WHEN 0 THEN 'discovered' WHEN 1 THEN 'eligible' WHEN 2 THEN 'archived'
      ELSE 'normalized' END AS status,
    CASE WHEN p_partkey % 17 <> 0
      THEN make_timestamp((1704067200 + p_size * 86400)::BIGINT * 1000000) END AS posted_at,
    make_timestamp((1709251200 + p_partkey)::BIGINT * 1000000) AS created_at,
    p_retailprice AS pay_min,
    'https://example.com/jobs/' || p_partkey AS canonical_url
  FROM part)"""

COMPANIES = """
companies AS (
  SELECT s_suppkey AS company_id, s_name AS company_name, n_name AS country, r_name AS market
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

RESUMES = """
resume_lines AS (
  SELECT o_custkey, l_linenumber, l_partkey, p_name, p_brand, p_type
  FROM (SELECT o_custkey, max(o_orderkey) AS ok FROM orders GROUP BY 1)
  JOIN lineitem ON l_orderkey = ok JOIN part ON p_partkey = l_partkey),
resume_skills AS (
  SELECT DISTINCT o_custkey, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
    p_brand, lower(p_type)]) AS skill FROM resume_lines),
resume_first AS (
  SELECT o_custkey, p_name, p_type FROM resume_lines
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_linenumber, l_partkey) = 1),
resumes AS (
  SELECT c_custkey AS resume_id, translate(c_name, '#0123456789', ' abcdefghij') AS name, f.p_name AS headline,
    'Works in ' || lower(c_mktsegment) AS summary,
    (SELECT list(skill ORDER BY skill) FROM resume_skills s WHERE s.o_custkey = c_custkey) AS skills,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment,
    'Delivered ' || lower(f.p_type) || ' parts' AS bullet,
    'NATION_' || c_nationkey AS location,
    CASE c_nationkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END
      AS preferred_remote
  FROM customer JOIN resume_first f ON f.o_custkey = c_custkey)"""

OBSERVATIONS = """
observations AS (
  SELECT CASE l_returnflag WHEN 'R' THEN 'remotive' WHEN 'N' THEN 'naukri' ELSE 'demo' END
      AS provider,
    l_partkey::VARCHAR AS external_id, p_name AS title,
    'Supplier #' || l_suppkey AS company_name,
    'Own ' || lower(p_type) || ' parts' AS description,
    CASE WHEN l_linestatus = 'O' THEN 'Remote - US' END AS location,
    [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand] AS skills,
    l_quantity AS pay_min,
    CASE WHEN l_suppkey % 3 = 0 THEN 'https://s' || l_suppkey || '.example' END AS company_website,
    l_shipdate AS retrieved_at,
    l_orderkey * 10 + l_linenumber AS position,
    CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS provider_rank
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""

COMMANDS = """
commands AS (
  SELECT event_id AS command_id, ts, user_id AS profile_id,
    (json_extract(props, '$.k')::INT % 10)::BIGINT AS posting_id,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'upsert'
      WHEN event_type = 'error' THEN 'delete' ELSE 'set_status' END AS op,
    CASE event_type WHEN 'signup' THEN 'interested' WHEN 'view' THEN 'tailored'
      WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'interview' ELSE 'cancelled' END AS status
  FROM events)"""

STOP = (
    "['a','an','and','or','the','to','of','in','on','for','with','at','by','from','as','is','are',"
    "'be','this','that','our','your','we','you','will','job','role','team','work','experience',"
    "'years','strong','preferred','required','using','etc']"
)


def tokens(expr: str) -> str:
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({expr}), "
        f"'[a-z0-9][a-z0-9+.#-]+')), lambda t: NOT list_contains({STOP}, t))"
    )


def level(expr: str) -> str:
    """Seniority of lower-case text; word ends are spelled out for RE2."""

    def word(words: str) -> str:
        return f"regexp_matches({expr}, '(^|[^\\pL\\pN_])({words})($|[^\\pL\\pN_])')"

    years = years_of(expr)
    return (
        f"CASE WHEN {word('senior|sr|staff|principal|lead|architect')} THEN 'senior' "
        f"WHEN {word('junior|jr|entry[- ]?level|intern|graduate|associate')} THEN 'junior' "
        f"WHEN {word('mid[- ]?level|intermediate')} THEN 'mid' "
        f"WHEN {years} >= 5 THEN 'senior' WHEN {years} <= 2 THEN 'junior' ELSE 'mid' END"
    )


def years_of(expr: str) -> str:
    return (
        "TRY_CAST(nullif(regexp_extract("
        f"{expr}, '(\\d+)\\+?\\s*(?:\\+|to|-)?\\s*(?:\\d+)?\\s*years?', 1), '') AS BIGINT)"
    )


def with_(*views: str) -> str:
    return "WITH " + ",".join(views)


# Features and score of every (resume, posting) pair, by brute force.
PAIR_SCORES = f"""
rf AS MATERIALIZED (
  SELECT resume_id, preferred_remote, list_sort(list_distinct([lower(s) FOR s IN skills])) AS rs,
    {tokens("headline || chr(10) || summary || chr(10) || array_to_string(skills, chr(10)) || chr(10)"
            " || headline || chr(10) || segment || chr(10) || bullet")} AS rt
  FROM resumes),
pf AS MATERIALIZED (
  SELECT posting_id, remote_type, created_at,
    list_sort(list_distinct([lower(s) FOR s IN skills])) AS js,
    {tokens("title")} AS tt,
    list_distinct(list_concat({tokens("title")},
      list_filter({tokens("description")}, lambda t: length(t) > 3))) AS kw
  FROM postings WHERE status IN ('discovered', 'normalized', 'eligible')),
overlap AS (
  SELECT resume_id, posting_id, sum(sk)::BIGINT AS n_skills, sum(ti)::BIGINT AS n_title,
    sum(ke)::BIGINT AS n_kw
  FROM (
    SELECT resume_id, posting_id, 1 AS sk, 0 AS ti, 0 AS ke
    FROM (SELECT resume_id, unnest(rs) AS x FROM rf) JOIN (SELECT posting_id, unnest(js) AS x FROM pf)
      USING (x)
    UNION ALL
    SELECT resume_id, posting_id, 0, 1, 0
    FROM (SELECT resume_id, unnest(rt) AS x FROM rf) JOIN (SELECT posting_id, unnest(tt) AS x FROM pf)
      USING (x)
    UNION ALL
    SELECT resume_id, posting_id, 0, 0, 1
    FROM (SELECT resume_id, unnest(rt) AS x FROM rf) JOIN (SELECT posting_id, unnest(kw) AS x FROM pf)
      USING (x))
  GROUP BY 1, 2),
counted AS (
  SELECT resume_id, posting_id, created_at, rs, js, rt, tt, n_skills, n_title, n_kw,
    len(kw) AS kw_size,
    CASE WHEN preferred_remote = remote_type THEN 0.05::DOUBLE
      WHEN preferred_remote = 'remote' AND remote_type <> 'onsite' THEN 0.02::DOUBLE
      ELSE 0::DOUBLE END AS remote_bonus
  FROM overlap JOIN rf USING (resume_id) JOIN pf USING (posting_id)),
measured AS (
  SELECT *, n_skills::DOUBLE / len(js) AS skill_coverage,
    CASE WHEN len(tt) = 0 THEN 0 ELSE n_title::DOUBLE / len(tt) END AS title_similarity,
    CASE WHEN kw_size = 0 THEN 0 ELSE least(1.0::DOUBLE, n_kw::DOUBLE / least(kw_size, 40)) END
      AS keyword_presence
  FROM counted),
pair_scores AS MATERIALIZED (
  SELECT *, round(greatest(0::DOUBLE, least(1::DOUBLE, 0.55::DOUBLE * skill_coverage
      + 0.25::DOUBLE * title_similarity + 0.20::DOUBLE * keyword_presence + remote_bonus
    ))::DECIMAL(38, 20), 4)::DOUBLE AS score,
    round(least(1::DOUBLE, 0.35::DOUBLE + 0.15::DOUBLE * ((len(rs) > 0)::INT + (len(js) > 0)::INT
      + (len(tt) > 0)::INT + (len(rt) > 0)::INT) + 0.2::DOUBLE * skill_coverage)
      ::DECIMAL(38, 20), 4)::DOUBLE AS confidence
  FROM measured)"""


def best_pairs(k: int, min_score: float = 0.0) -> str:
    return f"""
best AS (
  SELECT *, row_number() OVER (PARTITION BY resume_id
      ORDER BY score DESC, created_at DESC, posting_id) AS rank
  FROM pair_scores WHERE score >= {min_score}
  QUALIFY rank <= {k})"""
