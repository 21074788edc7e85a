"""One query for each operator, over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hangarlog.llm import ann, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, license_scan, mixing, packing, quality, sharding
from hangarlog.llm import url_filter, whitening
from hangarlog.llm.frames import table

SHARDS = 40
# The rules that hold for every page.
URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: The block list that decides where no rule fits: site names under each of the domains below.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


def tokenizer_path() -> str:
    """The public tokenizer that op6 packs for."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, folder, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame([(f"{s}.{d}",) for s in LISTED_SITES for d in LISTED_DOMAINS], "host string")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES, listed).drop("url")


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, folder, "documents")).select("doc_id", "class_id", "copies_id", "n_links")


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.copy_counts(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(), with_ids=False)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, folder, "labels")))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents"))[1]


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn_profiles(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, folder, "embeddings"), label, F.col("vec_id") % 50 == 0)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    parts = rows.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"), "identity_error")
    return parts.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "part.whitened", "part.explained", "identity_error")


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_exact_dedup, op3_url_filter, op4_ngram_jaccard, op5_mixing, op6_packing,
                                    op7_quality, op8_license_scan, op9_language_id, op10_nearest, op11_hard_negatives, op12_whitening,
                                    op13_html_text, pipeline)}


_OP1 = f"""
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, text FROM documents),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS idx, sum(size) OVER () AS total FROM sized),
cut AS (
  SELECT *, least(cast(floor(cast(2 * start + size AS DOUBLE) * {SHARDS}.0e0 / (2.0e0 * total)) AS INT), {SHARDS - 1}) AS shard FROM placed)
SELECT doc_id, cast(size AS BIGINT) AS size, {{crc}} AS text_crc32, 'bytes' AS law, shard,
       cast(idx - min(idx) OVER (PARTITION BY shard) AS BIGINT) AS slot, cast(NULL AS INT) AS grown_shard
FROM cut"""

_OP2 = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM n WINDOW g AS (PARTITION BY text)"""

_OP3 = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(f"('{r}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{v}')" for r, v in URL_RULES)}),
found AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS place
  FROM parts p LEFT JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN regexp_matches(host,
       '(^|\\.)({'|'.join(LISTED_SITES)})\\.({'|'.join(d.replace('.', chr(92) + '.') for d in LISTED_DOMAINS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM found WHERE place = 1"""

_OP11 = """
WITH sized AS (SELECT max(d) AS d FROM (SELECT len(embedding) AS d, count(*) AS n FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY n DESC, d LIMIT 1) s),
r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings, sized
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = d AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""


def oracle_sql() -> dict[str, str]:
    """DuckDB has no crc32, so op1 has no twin here; its test computes one."""
    return {"op2_exact_dedup": _OP2, "op3_url_filter": _OP3, "op11_hard_negatives": _OP11}
