"""Compares keyword, vector and hybrid search on labelled cases.

    python -m jobs.retrieval_report DOCUMENTS EMBEDDINGS REPORT [--config jobs/retrieval_report.toml]

DOCUMENTS (doc_id, text, lang, source) and EMBEDDINGS (vec_id, embedding, label) are Parquet. A case is
a document whose vector's id is divisible by ``cases_every``: it asks for its source and language by
keywords, with its own vector, and with both, and documents of its label are relevant. REPORT/cases
has the metrics of each case and REPORT/averages their means, both partitioned by method. Only ranked
documents are judged; how many are relevant is counted by label. A rerun writes the same partitions again.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.folders import scratch
from gleanery.operators import evaluation, retrieval
from jobs.settings import from_toml

LOG = logging.getLogger("jobs.retrieval_report")


@dataclass(frozen=True)
class Config:
    cases_every: int = 100
    keyword_k: int = 20
    semantic_k: int = 20
    hybrid_k: int = 20
    rrf_k: int = 60
    keyword_weight: float = 1.0
    semantic_weight: float = 1.0


def judged(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """case_id and rank of the relevant hits: those of the case's label."""
    of_case = labels.select(F.col("item_id").alias("query_id"), F.col("label").alias("_wanted"))
    ranks = evaluation.first_ranks(hits.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("item_id"), "rank"))
    return ranks.join(labels, "item_id").join(of_case, F.col("case_id") == F.col("query_id")).where(F.col("label") == F.col("_wanted")).select("case_id", "rank")


def run(spark: SparkSession, documents: str, embeddings: str, output: str, config: Config = Config()) -> None:
    docs = spark.read.schema("doc_id long, text string, lang string, source string").parquet(documents).where("doc_id is not null")
    vectors = spark.read.schema("vec_id long, embedding array<float>, label int").parquet(embeddings).where("vec_id is not null and label is not null")
    text = lambda name: F.coalesce(name, F.lit(""))
    path = F.concat_ws("/", text("source"), F.concat(F.col("doc_id"), F.lit(".txt")))
    chunks = docs.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.sha2(path, 256).alias("document_id"), path.alias("source_path"), F.col("doc_id").cast("int").alias("sequence"),
        text("lang").alias("section_title"), F.array(text("source"), text("lang")).alias("section_path"), text("text").alias("text"),
    )
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id"), "source", "lang"), "vec_id")
    usable = known.where(retrieval.valid_vector(F.col("embedding")) & (retrieval.norm(F.col("embedding").cast("array<double>")) > 0))
    cases = usable.where(F.col("vec_id") % config.cases_every == 0).select(F.col("vec_id").cast("string").alias("query_id"), F.concat_ws(" ", "source", "lang").alias("query"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    labels = known.select(F.col("vec_id").cast("string").alias("item_id"), "label")
    LOG.info("read %d documents of %s and %d vectors of %s: %d cases", docs.count(), documents, vectors.count(), embeddings, cases.count())

    near = chunks.drop("text").join(usable.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector")), "chunk_id")
    found = {
        "keyword": retrieval.keyword_search_table(chunks, cases.select("query_id", "query"), config.keyword_k),
        "semantic": retrieval.semantic_search(near, cases.select("query_id", "vector"), config.semantic_k),
    }
    # Written, as the fusion and the report both read them.
    hits = {name: _kept(rows, scratch(spark, f"report-{name}")) for name, rows in found.items()}
    hits["hybrid"] = retrieval.fuse(hits["keyword"], hits["semantic"], config.hybrid_k, rrf_k=config.rrf_k, keyword_weight=config.keyword_weight, semantic_weight=config.semantic_weight)
    totals = cases.select(F.col("query_id").alias("case_id"), "label").join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("case_id", "n")
    for method, rows in hits.items():
        per_case = evaluation.scores(judged(rows, labels), totals, totals.select("case_id"))
        _write(per_case, method, f"{output}/cases")
        own = spark.read.parquet(f"{output}/cases").where(F.col("method") == method).drop("method")
        _write(evaluation.averages(own), method, f"{output}/averages")
        LOG.info("wrote the metrics of %d cases by %s to %s", own.count(), method, output)


def _kept(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _write(rows: DataFrame, method: str, path: str) -> None:
    rows.withColumn("method", F.lit(method)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Compare the ways to search on labelled cases.")
    parser.add_argument("documents")
    parser.add_argument("embeddings")
    parser.add_argument("report")
    parser.add_argument("--config")
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("retrieval-report").getOrCreate()
    try:
        run(spark, args.documents, args.embeddings, args.report, from_toml(Config, args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
