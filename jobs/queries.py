"""The jobs as queries: each runs twice into one new folder, and the whole output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.folders import scratch
from gleanery.operators.evaluation import CUTOFFS, METRICS
from gleanery.operators.postings import KeywordIndex
from gleanery.plans.catalog import TABLE_WORDS
from jobs import keyword_index, retrieval_report


def job1_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job1")
    for _ in range(2):
        # As a pattern, as a file stream takes a folder or a pattern, and the table may be a single file.
        keyword_index.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/index", f"{folder}/checkpoint")
    return KeywordIndex(spark, f"{folder}/index").entries().select("piece", "document_id", F.col("points").cast("long").alias("points"))


JOB1_SQL = r"""
WITH fields AS (
  SELECT sha256(source || '/' || doc_id || '.txt') AS document_id, unnest([
    {'text': lower(text), 'points': 1}, {'text': lower(lang), 'points': 2}, {'text': lower('["' || source || '","' || lang || '"]'), 'points': 2}]) AS f FROM documents
), pieces AS (
  SELECT document_id, f.points AS points, unnest(list_distinct(regexp_extract_all(f.text, '[A-Za-z0-9_]+|[\p{L}\p{N}+#]'))) AS piece FROM fields
)
SELECT piece, document_id, sum(points)::BIGINT AS points FROM pieces GROUP BY piece, document_id
"""


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/embeddings.parquet", f"{folder}/report")
    found = spark.read.parquet(f"{folder}/report/cases")
    return found.select("method", F.col("case_id").cast("string").alias("case_id"), *(F.round(name, 6).alias(name) for name in METRICS))


def _measures() -> str:
    cut = lambda k: f"round(coalesce(count(rank) FILTER (rank <= {k}) / any_value(n), 0), 6) AS recall_at_{k}"
    gain = lambda k: f"round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}) / list_sum(list_transform(range(1, least(any_value(n), {k}) + 1), lambda r: 1 / log2(r + 1))), 0), 6) AS ndcg_at_{k}"
    return ", ".join([*map(cut, CUTOFFS), *map(gain, CUTOFFS), "round(coalesce(1 / min(rank), 0), 6) AS mrr"])


JOB2_SQL = f"""
WITH {TABLE_WORDS}, known AS (
  SELECT vec_id, label, embedding, source || '/' || doc_id || '.txt' AS source_path FROM embeddings JOIN documents ON doc_id = vec_id WHERE label IS NOT NULL
), cases AS (
  SELECT vec_id::VARCHAR AS case_id, label, embedding, (SELECT count(*) FROM known k WHERE k.label = c.label) AS n FROM known c WHERE vec_id % 100 = 0
), near AS (
  SELECT query_id, chunk_id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(source_path), chunk_id::BIGINT) AS rank FROM (
      SELECT case_id AS query_id, vec_id::VARCHAR AS chunk_id, source_path, greatest(-1, least(1, list_cosine_similarity(known.embedding::DOUBLE[], cases.embedding::DOUBLE[]))) AS score
      FROM known, cases)) WHERE rank <= 20
), lexical AS (
  SELECT query_id, chunk_id, rank FROM words JOIN cases ON query_id = case_id
), fused AS (
  SELECT coalesce(w.query_id, s.query_id) AS query_id, coalesce(w.chunk_id, s.chunk_id) AS chunk_id, w.rank AS keyword_rank, s.rank AS semantic_rank,
         coalesce(1e0 / (60e0 + w.rank), 0e0) + coalesce(1e0 / (60e0 + s.rank), 0e0) AS score
  FROM lexical w FULL OUTER JOIN near s ON w.query_id = s.query_id AND w.chunk_id = s.chunk_id
), hybrid AS (
  SELECT query_id, chunk_id, rank FROM (
    SELECT fused.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(semantic_rank, 2147483648), coalesce(keyword_rank, 2147483648)), coalesce(semantic_rank, 2147483648),
           coalesce(keyword_rank, 2147483648), lower(source || '/' || doc_id || '.txt'), sha256(source || '/' || doc_id || '.txt'), doc_id) AS rank
    FROM fused JOIN documents ON chunk_id = doc_id::VARCHAR) WHERE rank <= 20
), hits AS (
  SELECT 'keyword' AS method, * FROM lexical UNION ALL SELECT 'semantic', * FROM near UNION ALL SELECT 'hybrid', * FROM hybrid
), relevant AS (
  SELECT method, query_id, rank FROM hits JOIN cases ON query_id = case_id JOIN known ON chunk_id = vec_id::VARCHAR AND known.label = cases.label
)
SELECT c.method, case_id, {_measures()} FROM (SELECT method, cases.* FROM cases, (VALUES ('keyword'), ('semantic'), ('hybrid')) m(method)) c LEFT JOIN relevant r ON r.method = c.method AND query_id = case_id
GROUP BY c.method, case_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_keyword_index": job1_keyword_index, "job2_retrieval_report": job2_retrieval_report}
SQL: dict[str, str] = {"job1_keyword_index": JOB1_SQL, "job2_retrieval_report": JOB2_SQL}
