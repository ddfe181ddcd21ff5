"""The registered queries of the operators, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import round_trip_digests
from .html_text import extract_text
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .media import image_groups, vector_media
from .packing import pack_documents
from .quality import judge_quality
from .simhash import simhash_components
from .url_filter import filter_urls
from .warc import read_archives, write_archives

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Where no rule above fits: hosts that the method blocks of itself.
MORE_URL_RULES = [("block", "spam-farm.example.org", "/"), ("block", "spam-farm.example.net", "/"), ("block", "cheap-pills.example.org", "/"), ("block", "cheap-pills.example.net", "/")]


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, more_rules=MORE_URL_RULES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).withColumnRenamed("doc", "doc_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken")).withColumnRenamed("doc", "doc_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_groups(vector_media(_table(spark, sf_dir, "embeddings"))).withColumnRenamed("media", "media_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("doc", "doc_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "fingerprint", F.col("component").alias("component_id"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = write_archives(_table(spark, sf_dir, "pages"))
    out = read_archives(files, path)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_packing, op4_byte_bpe, op5_quality, op6_media, op7_html_text, op8_licenses, op9_simhash, op10_warc)}

_OP1 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(tier, verdict, r_host, r_path) AS (VALUES
  {rules}
), fits AS (
  SELECT page_id, host, path, tier, r_host || r_path AS rule, verdict FROM hosts
  LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier DESC, length(rule) DESC) AS k FROM fits
)
SELECT page_id, host, path, CASE WHEN tier = 2 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
""".replace("{rules}", ", ".join(f"({t}, '{v}', '{h}', '{p}')" for t, rows in ((2, URL_RULES), (1, MORE_URL_RULES)) for v, h, p in rows))

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_WHITE}), {_LOWER}) AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, f.owner IS NOT NULL AND f.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP10 = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS owner FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
    (CAST('0x' || substr(hex || '0', 1 + (5 * i) // 4, 2) AS INTEGER) >> (3 - (5 * i) % 4)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM grouped
"""

ORACLE_SQL = {"op1_url_filter": _OP1, "op2_line_dedup": _OP2, "op10_warc": _OP10}
