"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, kneser_ney, language, packing, quality, sharding, shingle_join, substrings, url_filter, vector_dedup
from cairn.llm.common import crc_bucket

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The rules of the contract as (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).drop("url")


ORACLES["op3_url_filter"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_files() -> dict[str, str]:
    """The public tokenizer of the contract; its ranks file holds the same vocabulary."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), **tokenizer_files())


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names, log_p = language.train(docs)
    told = language.predict(docs.select("doc_id", "text"), names, log_p)
    return told.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op1_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
b AS (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS p FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, array_to_string(ws[p + 1 : p + 10], ' ') AS win, len(ws[p + 1 : p + 10]) AS n FROM b),
q AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS p FROM d),
h AS (
  SELECT q.doc_id, q.p, l.n, w.item_id
  FROM q JOIN (SELECT DISTINCT n FROM w) l ON q.p + l.n <= len(q.ws)
  JOIN w ON w.n = l.n AND w.win = array_to_string(q.ws[q.p + 1 : q.p + l.n], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(g.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, num=85, den=100)


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(_table(spark, sf_dir, "embeddings"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 10) == 0
    model = kneser_ney.train(docs.where(~held_out))
    return kneser_ney.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 3, 1))) AS p FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
z AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, z.b FROM r JOIN z ON z.a = r.reached)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""

ORACLES["op2_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
z AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, z.b FROM r JOIN z ON z.a = r.reached),
n AS (SELECT a, count(*) AS n FROM z GROUP BY a)
SELECT r.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(reached) AS component_id, r.vec_id = min(reached) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
"""

ORACLES["op6_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, b, unnest(range(0, n - 199)) AS p FROM n WHERE n >= 200),
h AS (SELECT doc_id, p, md5(b[p + 1 : p + 200]) AS h FROM p),
o AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
w AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM h JOIN o ON o.h = h.h),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM w),
r AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM r),
t AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans, max(e) AS last FROM r GROUP BY doc_id),
c AS (
  SELECT k.doc_id, k.s AS place, CASE WHEN k.s > k.before THEN hex(n.b[k.before + 1 : k.s]) ELSE '' END AS kept FROM k JOIN n ON n.doc_id = k.doc_id
  UNION ALL SELECT n.doc_id, coalesce(t.last, 0) + 1000000000, CASE WHEN n.n > coalesce(t.last, 0) THEN hex(n.b[coalesce(t.last, 0) + 1 : n.n]) ELSE '' END FROM n LEFT JOIN t ON t.doc_id = n.doc_id),
f AS (SELECT doc_id, sha256(unhex(string_agg(kept, '' ORDER BY place))) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(t.removed, 0)::BIGINT AS n_removed, coalesce(t.spans, 0)::BIGINT AS n_spans, f.kept_sha256
FROM n LEFT JOIN t ON t.doc_id = n.doc_id JOIN f ON f.doc_id = n.doc_id
"""
