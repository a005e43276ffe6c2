"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exactdedup, html, jaccard, langid, linededup, pii, tokencount, warc
from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The counts are the patterns' own, so that they are exact as the hash is; what the field adds is in spans.
    return pii.digest(pii.find(table(spark, sf_dir, "documents")), counted="base")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(table(spark, sf_dir, "documents"), decoded="decoded")
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents")).withColumnsRenamed({"keep_id": "keep_doc_id", "keep_line": "keep_line_no"})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exactdedup.exact_dedup(docs, carry={"text_sha256": F.sha2(exactdedup.normalised(F.col("text")), 256)}).drop("_sha")


OP10_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


_REFERENCES = "t"
for _name, _char in warc.REFERENCES:
    _REFERENCES = f"replace({_REFERENCES}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"

_UUID = "'urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"

OP8_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html,
         md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h
  FROM pages),
r AS (
  SELECT *, {_UUID.format("h")} AS refers_to, 'sha256:' || sha256(html) AS source_digest,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
           || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers
  FROM p),
i AS (
  SELECT *, {_UUID.format("md5('metadata|' || refers_to)")} AS meta_id, {_UUID.format("md5('conversion|' || refers_to)")} AS text_id FROM r),
a AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'),
    '(?i)</?(?:{warc.BREAKS})(?:[ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t
  FROM i),
m AS (
  SELECT *, regexp_replace(regexp_replace({_REFERENCES}, ' *\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS plain,
    'http-status: 200' || chr(13) || chr(10) || 'content-type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'title: ' || regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t\\r\\n\\f]+', ' ', 'g') || chr(13) || chr(10)
      || 'links: ' || len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) || chr(13) || chr(10)
      || 'source-digest: ' || source_digest || chr(13) || chr(10) AS meta
  FROM a),
b AS (
  SELECT page_id, 'metadata' AS record_type, meta_id AS record_id, refers_to, text_id AS concurrent_to, target_uri,
         'application/warc-fields' AS content_type, source_headers, source_digest, meta AS block FROM m
  UNION ALL
  SELECT page_id, 'conversion', text_id, refers_to, meta_id, target_uri, 'text/plain; charset=utf-8', source_headers, source_digest, plain FROM m)
SELECT *, '{warc.DATE}' AS date, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS n_bytes FROM b
""".replace("\\\\", "\\")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL, "op10_exact_dedup": OP10_SQL}
