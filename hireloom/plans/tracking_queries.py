"""Application tracking and metric queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.operators import metrics, vectors
from hireloom.operators import tracking as t
from hireloom.plans import oracle as o
from hireloom.plans.registry import query
from hireloom.sources import bindings as b

HISTORY = f"""{o.COMMANDS},
keyed AS (
  SELECT *, 'track:' || profile_id || ':' || posting_id AS application_key FROM commands),
starts AS (
  SELECT application_key, min({{'ts': ts, 'c': command_id}}) AS s FROM keyed WHERE op = 'upsert' GROUP BY 1),
live AS (
  SELECT k.*, lag(status) OVER (PARTITION BY application_key ORDER BY ts, command_id) AS from_status
  FROM keyed k JOIN starts USING (application_key) WHERE {{'ts': ts, 'c': command_id}} >= s),
history AS (
  SELECT application_key, profile_id, posting_id, command_id, from_status, status AS to_status,
    CASE WHEN from_status IS NULL THEN 'tracker_create' WHEN op = 'upsert' THEN 'tracker_upsert'
      WHEN op = 'delete' THEN 'tracker_remove' ELSE 'status_update' END AS reason, ts AS created_at
  FROM live WHERE from_status IS NULL OR op = 'delete' OR status <> from_status),
applications AS (
  SELECT application_key, profile_id, posting_id, arg_max(to_status, {{'ts': created_at, 'c': command_id}})
    AS status, min(created_at) AS created_at, max(created_at) AS updated_at
  FROM history GROUP BY 1, 2, 3)"""
H = o.with_(HISTORY)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = b.commands(spark, sf_dir).withColumn("application_key", t.default_key())
    return t.history(commands)


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.applications_after(_history(spark, sf_dir))


@query("application_history", f"""{H}
SELECT application_key, command_id, from_status, to_status, reason FROM history""")
def application_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select(
        "application_key", "command_id", "from_status", "to_status", "reason"
    )


@query("application_rejects", f"""{H}
SELECT command_id, op FROM keyed WHERE command_id NOT IN (SELECT command_id FROM live)""")
def application_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = b.commands(spark, sf_dir).withColumn("application_key", t.default_key())
    return t.rejected(commands).select("command_id", "op")


@query("application_two_batches", f"""{H}
SELECT application_key, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated FROM applications""")
def application_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the month, then the rest on top of the stored state."""
    commands = b.commands(spark, sf_dir).withColumn("idempotency_key", F.lit(None).cast("string"))
    cut = F.lit("2024-01-15").cast("timestamp")
    first = commands.filter(F.col("ts") < cut).withColumn("application_key", t.default_key())
    state = t.applications_after(t.history(first))
    second = t.resolve(commands.filter(F.col("ts") >= cut), state)
    return t.applications_after(t.history(second, state), state).select(
        "application_key", "status",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


@query("application_board", f"""{o.with_(HISTORY, o.POSTINGS, o.COMPANIES)}
SELECT application_key, a.status, title, company_name, canonical_url AS url
FROM applications a LEFT JOIN postings p USING (posting_id)
LEFT JOIN companies c ON c.company_id = p.company_id WHERE a.status <> 'cancelled'""")
def application_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.board(
        _applications(spark, sf_dir), b.postings(spark, sf_dir), b.companies(spark, sf_dir)
    ).select("application_key", "status", "title", "company_name", "url")


@query("latest_status", f"{H} SELECT application_key, status FROM applications")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.latest_status(_history(spark, sf_dir)).select("application_key", "status")


NEXT = """steps AS (
  SELECT *, lead(to_status) OVER w AS next_status,
    (epoch_us(lead(created_at) OVER w) - epoch_us(created_at)) / 1e6 AS seconds
  FROM history WINDOW w AS (PARTITION BY application_key ORDER BY created_at, command_id))"""


@query("status_durations", f"""{H}, {NEXT}
SELECT application_key, command_id, to_status, next_status, round(seconds, 3) AS seconds FROM steps""")
def status_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.durations(_history(spark, sf_dir)).select(
        "application_key", "command_id", "to_status", "next_status",
        F.round("seconds", 3).alias("seconds"),
    )


@query("status_transitions", f"""{H}, {NEXT}
SELECT to_status AS status, next_status, count(*) AS n, round(avg(seconds), 2) AS avg_seconds
FROM steps WHERE next_status IS NOT NULL GROUP BY 1, 2""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.transitions(_history(spark, sf_dir))


@query("illegal_transitions", f"""{H}
SELECT from_status, to_status, count(*) AS n FROM history WHERE from_status IS NOT NULL
  AND NOT (to_status = 'cancelled' OR (from_status, to_status) IN (('interested', 'tailored'),
    ('tailored', 'applied'), ('applied', 'interview'), ('interested', 'applied'))) GROUP BY 1, 2""")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("interested", "tailored"), ("tailored", "applied"), ("applied", "interview"),
             ("interested", "applied")]
    states = ["interested", "tailored", "applied", "interview", "cancelled"]
    allowed = spark.createDataFrame(
        steps + [(s, "cancelled") for s in states], "from_status string, to_status string"
    )
    return (
        t.illegal(_history(spark, sf_dir), allowed)
        .groupBy("from_status", "to_status")
        .agg(F.count("*").alias("n"))
    )


@query("funnel_rollup", f"""{o.with_(HISTORY, o.POSTINGS)}
SELECT provider, a.status, count(*) AS n,
  round(avg((a.status IN ('applied', 'interview'))::INT), 4) AS applied_rate,
  round(avg((a.status = 'interview')::INT), 4) AS interview_rate,
  grouping(provider, a.status) AS subtotal_level
FROM applications a JOIN postings USING (posting_id) GROUP BY ROLLUP (provider, a.status)""")
def funnel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = b.postings(spark, sf_dir).select("posting_id", "provider")
    return t.funnel(_applications(spark, sf_dir).join(provider, "posting_id"))


STEPS = ["interested", "applied", "interview", "cancelled"]
REACHED = ", ".join(f"max((to_status = '{s}')::INT) AS s{i}" for i, s in enumerate(STEPS))


@query("funnel_conversion", f"""{H},
r AS (SELECT application_key, {REACHED} FROM history GROUP BY 1)
""" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{s}' AS step, sum(s{i})::BIGINT AS applications, "
    + (f"round(sum(s{i - 1} * s{i}) / sum(s{i - 1}), 4)" if i else "NULL::DOUBLE") + " AS from_before FROM r"
    for i, s in enumerate(STEPS)
))
def funnel_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.conversion(_history(spark, sf_dir), STEPS)


@query("match_acceptance", f"""{H},
shown AS (SELECT l_suppkey AS profile_id, l_partkey % 10 AS posting_id, l_returnflag AS channel FROM lineitem),
taken AS (SELECT DISTINCT profile_id, posting_id FROM applications)
SELECT channel, count(*) AS shown, count(t.profile_id) AS accepted, round(count(t.profile_id) / count(*), 4) AS acceptance_rate
FROM shown s LEFT JOIN taken t ON t.profile_id = s.profile_id AND t.posting_id = s.posting_id GROUP BY 1""")
def match_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines stand for matches shown to a profile, by the way they came."""
    shown = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("profile_id"), (F.col("l_partkey") % 10).alias("posting_id"), F.col("l_returnflag").alias("channel")
    )
    return t.acceptance(shown, _applications(spark, sf_dir), ["channel"])


KEYED = f"""{o.COMMANDS},
named AS (SELECT *, CASE WHEN command_id % 3 = 0 THEN 'req-' || profile_id || '-' || (command_id % 4) END AS idempotency_key FROM commands),
lives AS (SELECT *, coalesce(idempotency_key, 'track:' || profile_id || ':' || posting_id) AS own_key,
  coalesce(sum((op = 'delete')::INT) OVER (pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life
  FROM named WINDOW pair AS (PARTITION BY profile_id, posting_id ORDER BY ts, command_id)),
owned AS (SELECT *, first_value(CASE WHEN op = 'upsert' THEN own_key END IGNORE NULLS) OVER (
  PARTITION BY profile_id, posting_id, life ORDER BY ts, command_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS owner FROM lives),
made AS (SELECT *, list(CASE WHEN op = 'upsert' THEN owner END) OVER (
  PARTITION BY profile_id, posting_id ORDER BY ts, command_id ROWS UNBOUNDED PRECEDING) AS made FROM owned),
keyed AS (SELECT * EXCLUDE (owner, made),
  CASE WHEN list_contains(made, own_key) THEN own_key ELSE coalesce(owner, own_key) END AS application_key FROM made),"""
KEYED_HISTORY = f"{KEYED} {HISTORY[HISTORY.index('starts AS'):]}"


def keyed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of which a third carry a key; a key is used for several postings of a profile."""
    key = F.concat(F.lit("req-"), F.col("profile_id").cast("string"), F.lit("-"), (F.col("command_id") % 4).cast("string"))
    return b.commands(spark, sf_dir).withColumn("idempotency_key", F.when(F.col("command_id") % 3 == 0, key))


@query("application_keys", f"""{o.with_(KEYED_HISTORY)}
SELECT application_key, command_id, from_status, to_status, reason FROM history""")
def application_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.history(t.resolve(keyed_commands(spark, sf_dir))).select("application_key", "command_id", "from_status", "to_status", "reason")


@query("weekly_active", """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period,
  count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def weekly_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.active_users(b.table(spark, sf_dir, "events"))


@query("retention", """WITH a AS (
  SELECT DISTINCT user_id, date_trunc('week', ts) AS p FROM events),
f AS (SELECT user_id, min(p) AS c FROM a GROUP BY 1)
SELECT strftime(c, '%Y-%m-%d') AS cohort, datediff('day', c, p) // 7 AS step, count(*) AS users
FROM a JOIN f USING (user_id) GROUP BY 1, 2""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retention(b.table(spark, sf_dir, "events"))


@query("monthly_retention", """WITH a AS (
  SELECT DISTINCT user_id, date_trunc('month', ts) AS p FROM events),
f AS (SELECT user_id, min(p) AS c FROM a GROUP BY 1)
SELECT strftime(c, '%Y-%m-%d') AS cohort, datediff('month', c, p) AS step, count(*) AS users
FROM a JOIN f USING (user_id) GROUP BY 1, 2""")
def monthly_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retention(b.table(spark, sf_dir, "events"), "month")


@query("run_metrics", """WITH r AS (
  SELECT event_type AS agent_name, value AS seconds, json_extract(props, '$.k')::INT AS k FROM events)
SELECT agent_name, count(*) AS runs, round(avg((k % 10 <> 0)::INT), 4) AS completion_rate,
  round(avg(seconds), 4) AS avg_seconds, quantile_disc(seconds, 0.5) AS p50_seconds,
  quantile_disc(seconds, 0.95) AS p95_seconds, sum(k * 10)::BIGINT AS tokens,
  sum(k % 3)::BIGINT AS retries FROM r GROUP BY 1""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    runs = b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("agent_name"),
        F.when(k % 10 != 0, "succeeded").otherwise("failed").alias("status"),
        F.col("value").alias("seconds"),
        (k * 10).cast("bigint").alias("tokens"),
        (k % 3 + 1).alias("attempts"),
    )
    return metrics.run_metrics(runs, ["agent_name"])


@query("event_backlog", """SELECT event_type, count(*) AS n,
  max(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)))::BIGINT AS oldest_seconds FROM events
WHERE json_extract(props, '$.k')::INT % 4 = 0 GROUP BY 1""")
def event_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    ts = F.col("ts").cast("timestamp")
    events = b.table(spark, sf_dir, "events").select(
        "event_type", ts.alias("ts"), F.when(k % 4 != 0, ts).alias("published_at")
    )
    return metrics.backlog(events, F.lit("2024-02-01").cast("timestamp"))


@query("precision_at_k", """WITH r AS (
  SELECT source, quality AS relevant, row_number() OVER (
    PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS shown, round(avg(relevant), 4) AS precision FROM r
WHERE rank <= 5 GROUP BY 1""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("relevant"))
    ranked = docs.join(labels, "doc_id")
    return metrics.precision_at_k(ranked, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query("market_signals", f"""{o.with_(o.POSTINGS)}, s AS (
  SELECT unnest(skills) AS skill, remote_type, pay_min FROM postings)
SELECT skill, remote_type, count(*) AS demand, round(avg(pay_min::DECIMAL(18, 2)), 4) AS avg_pay,
  max(pay_min) AS max_pay, grouping(skill, remote_type) AS subtotal_level
FROM s GROUP BY CUBE (skill, remote_type)""")
def market_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.market_signals(b.postings(spark, sf_dir))


@query("place_signals", f"""{o.with_(o.POSTINGS)}
SELECT location, strftime(date_trunc('month', posted_at), '%Y-%m-%d') AS period, count(*) AS demand,
  round(quantile_cont(pay_min, 0.1), 2) AS pay_p10, round(quantile_cont(pay_min, 0.5), 2) AS pay_p50,
  round(quantile_cont(pay_min, 0.9), 2) AS pay_p90 FROM postings GROUP BY 1, 2""")
def place_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.place_signals(b.postings(spark, sf_dir))


SHARES, RANK_ERROR = {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 0.02


@query("pay_sketch_rollup", f"""{o.with_(o.POSTINGS)}
SELECT location, count(*) AS demand, true AS p10_close, true AS p50_close, true AS p90_close
FROM (SELECT location, unnest(skills) AS skill FROM postings) GROUP BY 1""")
def pay_sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay quantiles of places, merged from the sketches of place, period and skill, and whether their exact ranks are close."""
    posted = b.postings(spark, sf_dir)
    places = metrics.sketch_quantiles(metrics.merged_sketches(metrics.pay_sketches(posted, 400), ["location"]), SHARES)
    pays = posted.select("location", F.explode("skills"), F.col("pay_min").cast("double").alias("pay"))
    one = [places["location"].eqNullSafe(pays["location"])]
    below = [F.avg((F.col("pay") < F.col(n)).cast("int")).alias(f"{n}_below") for n in SHARES]
    upto = [F.avg((F.col("pay") <= F.col(n)).cast("int")).alias(f"{n}_upto") for n in SHARES]
    ranked = places.join(pays.drop("col"), one).groupBy(places["location"], "demand").agg(*below, *upto)
    close = [((F.col(f"{n}_below") <= q + RANK_ERROR) & (F.col(f"{n}_upto") >= q - RANK_ERROR)).alias(f"{n}_close") for n, q in SHARES.items()]
    return ranked.select("location", "demand", *close)


@query("own_board", f"""{o.with_(HISTORY, o.POSTINGS, o.COMPANIES)}
SELECT application_key, a.status, title, company_name, canonical_url AS url
FROM applications a LEFT JOIN postings p USING (posting_id)
LEFT JOIN companies c ON c.company_id = p.company_id WHERE a.status <> 'cancelled'
  AND profile_id = (SELECT min(profile_id) FROM applications WHERE status <> 'cancelled')""")
def own_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board of one profile, here the smallest one with an active application."""
    rows = _applications(spark, sf_dir)
    profile = rows.where("status <> 'cancelled'").select(F.min("profile_id")).scalar()
    return t.board(
        rows, b.postings(spark, sf_dir), b.companies(spark, sf_dir), owner=profile
    ).select("application_key", "status", "title", "company_name", "url")


WIDTH = 64


@query("vector_topk", """WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT list(a ORDER BY i) AS q FROM (
  SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY i))
SELECT vec_id, round(list_cosine_similarity(v, q), 4) AS similarity FROM e, m
ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = b.table(spark, sf_dir, "embeddings")
    centre = table.select(vectors.mean_vector("embedding", WIDTH)).scalar()
    return vectors.nearest(table, centre, 20).select(
        "vec_id", F.round("similarity", 4).alias("similarity")
    )


@query("vector_label_similarity", """WITH e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT label, list(a ORDER BY i) AS q FROM (
  SELECT label, i, avg(x) AS a FROM (
    SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(v, q), 4) AS similarity FROM e JOIN m USING (label)""")
def vector_label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = b.table(spark, sf_dir, "embeddings")
    centres = table.groupBy("label").agg(vectors.mean_vector("embedding", WIDTH).alias("centre"))
    return table.join(centres, "label").select(
        "vec_id", "label",
        F.round(vectors.cosine(F.col("embedding"), F.col("centre")), 4).alias("similarity"),
    )
