"""Registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hireloom.llm.cover_tree import exact_top_k
from hireloom.llm.licences import DIGESTS, LICENCES, NOTICES, canonical_sql, licence_scan
from hireloom.llm.merkle import merkle_manifest
from hireloom.llm.near_dedup import near_dedup
from hireloom.llm.nn_descent import nearest
from hireloom.llm.packing import packed
from hireloom.llm.piece_tokenizer import encode_pieces
from hireloom.llm.secrets import BASE_KINDS, secret_scan
from hireloom.llm.shared import new_folder
from hireloom.llm.simhash import simhash_dedup
from hireloom.llm.substring_dedup import substring_dedup
from hireloom.llm.toxicity import toxicity
from hireloom.llm.warc import read_pages, write_archives
from hireloom.llm.whitening import whiten

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = Query(build, sql)
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE doc_id > d),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
         [ws[j] FOR j IN range(1, len(ws) + 1) IF NOT list_contains(ps, j)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE
        list_distinct([ws[j] || ' ' || ws[j + 1] FOR j IN range(1, len(ws))]) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
         WHERE 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
reach AS (WITH RECURSIVE r(node, place) AS (SELECT doc_id, doc_id FROM s UNION
            SELECT r.node, l.b FROM r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON l.a = r.place)
          SELECT node, min(place) AS c FROM r GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN reach ON node = doc_id
"""


@query("op2_minhash_near_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2)


TOKENIZER = "word_bpe_49k.json"


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _joined(spans: str, *kinds: str) -> F.Column:
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("spans", *BASE_KINDS), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@query("op5_warc", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_pages(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM good q JOIN good d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


@query("op6_cover_tree_topk", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, each=True)


@query("op8_nn_descent")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


PIECE_MODEL = "piece_bpe_32k.model"


@query("op3_piece_tokenizer")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), verify=True, digest=True)


def _values(known: list[tuple[str, str]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)


OP7_SQL = f"""
WITH known AS (SELECT digest, min(n) AS licence_id FROM (SELECT sha256({canonical_sql("t")}) AS digest, n FROM (VALUES {_values(LICENCES)}) v(n, t)
  UNION ALL SELECT d, n FROM (VALUES {_values(DIGESTS)}) w(n, d)) GROUP BY 1),
notice AS (SELECT sha256({canonical_sql("t")}) AS digest, min(n) AS name FROM (VALUES {_values(NOTICES)}) v(n, t) GROUP BY 1),
d AS (SELECT doc_id, sha256({canonical_sql("coalesce(text, '')")}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
      FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS digest FROM l) JOIN notice USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, licence_id, coalesce(notices, '') AS notices FROM d LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
"""


@query("op7_licence_scan", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


@query("op11_simhash_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    # Null where the exact value is beyond a long.
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}"))

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS s, coalesce('=' || source, '') AS tree FROM documents),
c AS (SELECT rid, xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(s, '')])),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) AS crc FROM d WHERE s IS NOT NULL),
l AS (SELECT rid, doc_id, tree, sha256({_LEAF.format("text")}) AS leaf,
        sha256({_LEAF.format("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed
      FROM d LEFT JOIN c USING (rid)),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up(tree, lev, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT tree, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lev, pos // 3, n),
subroots AS (SELECT tree, h AS subroot, lev AS depth, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over(lev, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lev, pos // 3, n),
runs AS (SELECT tree, lev, pos, n, h, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lefts,
           string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rights
         FROM (SELECT * FROM up UNION ALL SELECT '/', lev, pos, n, h FROM over) WINDOW w AS (PARTITION BY tree, lev, pos // 3 ORDER BY pos)),
walk(rid, tree, lev, depth, base, pos, cur, proof) AS (
  SELECT rid, p.tree, 0, depth, s.pos, CASE WHEN depth = 0 THEN s.pos ELSE p.pos END, changed, '' FROM p JOIN subroots s USING (tree)
  UNION ALL
  SELECT w.rid, w.tree, w.lev + 1, w.depth, w.base, CASE WHEN w.lev + 1 = w.depth THEN w.base ELSE w.pos // 3 END,
    sha256(coalesce(lefts, '') || cur || coalesce(rights, '')), proof || coalesce(lefts, '') || coalesce(rights, '')
  FROM walk w JOIN runs r ON r.tree = CASE WHEN w.lev < w.depth THEN w.tree ELSE '/' END
    AND r.lev = CASE WHEN w.lev < w.depth THEN w.lev ELSE w.lev - w.depth END AND r.pos = w.pos
  WHERE r.n > 1),
ends AS (SELECT rid, cur, proof FROM walk QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lev DESC) = 1),
top AS (SELECT h AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM p JOIN subroots USING (tree) JOIN ends USING (rid) CROSS JOIN top
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle_manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], found={"text": tampered})
    proof = F.sha2(F.replace(F.array_join("proof", ""), F.lit("|"), F.lit("")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
