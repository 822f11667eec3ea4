"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, embedding_dedup, langid, licenses, line_dedup, repair, simhash, sptok, suffix_dedup, toxicity
from gridloom.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, count_col="n_dropped")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


def op9_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.shards(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sptok.encode(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_line_dedup, op3_toxicity, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_license_scan, op7_language_id, op8_embedding_near_dedup, op9_repair_shards, op10_sentencepiece)}

SQL = {
    "op2_line_dedup": """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents
), hosts AS (SELECT source, count(*) AS n_host FROM documents GROUP BY source
), bad AS (
  SELECT l.source, trim(line, ' ') AS t FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  WHERE trim(line, ' ') <> '' GROUP BY l.source, trim(line, ' '), n_host
  HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) > CAST(0.03 AS DOUBLE) * n_host
), marked AS (
  SELECT l.*, b.t IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.t
)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '') END AS text,
  CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.source, d.text""",
    "op5_suffix_array_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50)
), dup AS (
  SELECT doc_id, s, first_value(doc_id) OVER g AS fd, first_value(s) OVER g AS fs FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1
  WINDOW g AS (PARTITION BY k ORDER BY doc_id, s)
), islands AS (
  SELECT *, s - row_number() OVER (PARTITION BY doc_id, fd, fs - s ORDER BY s) AS island FROM dup
)
SELECT doc_id, CAST(min(s) - 1 AS BIGINT) AS start, CAST(count(*) + 49 AS BIGINT) AS n_words, fd AS first_doc_id, CAST(min(fs) - 1 AS BIGINT) AS first_start, doc_id = fd AND min(s) = min(fs) AS is_first
FROM islands GROUP BY doc_id, fd, fs - s, island""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= CAST(0.95 AS DOUBLE) * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
)
SELECT r.a AS vec_id, min(r.b) AS group_id, min(r.b) <> r.a AS is_duplicate, any_value(coalesce(k.n, 0)) AS n_links
FROM reach r LEFT JOIN (SELECT near.a, count(DISTINCT w.e) AS n FROM near JOIN v w ON near.b = w.vec_id JOIN v u ON near.a = u.vec_id WHERE u.e <> w.e GROUP BY near.a) k ON r.a = k.a GROUP BY r.a""",
}
