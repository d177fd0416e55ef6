"""Keeps a keyword index up to date with a folder of documents.

    python -m jobs.keyword_index DOCUMENTS INDEX CHECKPOINT [--config jobs/keyword_index.toml]

DOCUMENTS is a folder of Parquet files (doc_id, text, lang, source), or a pattern of their paths. A run takes the files that came since the
last one, told by a file stream's checkpoint, in batches; each batch is a partition of the index's
tables, so that a batch which is taken again after a failure takes its own place. A document that comes
again replaces its earlier version: within a batch the newest file's counts, else the last batch's.
Rows without a doc_id are left out and counted.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.postings import KeywordIndex
from gleanery.sizing import shuffles_for
from jobs.settings import from_toml

LOG = logging.getLogger("jobs.keyword_index")
DOCUMENTS = "doc_id long, text string, lang string, source string"


@dataclass(frozen=True)
class Config:
    files_a_batch: int = 500

    def __post_init__(self) -> None:
        if self.files_a_batch < 1:
            raise ValueError("files_a_batch is at least 1")


def document_chunks(rows: DataFrame) -> DataFrame:
    """Documents (with the file's time as _came) as one chunk each, all versions of each path."""
    text = lambda name: F.coalesce(name, F.lit(""))
    path = F.concat_ws("/", text("source"), F.concat(F.col("doc_id"), F.lit(".txt")))
    named = rows.where("doc_id is not null").select(path.alias("source_path"), "_came", *(text(name).alias(name) for name in ("text", "lang", "source")))
    return named.select(
        F.sha2("source_path", 256).alias("chunk_id"), F.sha2("source_path", 256).alias("document_id"), "source_path", F.lit(0).alias("sequence"),
        "text", F.col("lang").alias("section_title"), F.array("source", "lang").alias("section_path"), "_came",
    )


def newest() -> tuple[Column, ...]:
    """Of a document's versions in a batch the newest file's comes first; of one file's, one that doesn't depend on their order."""
    return F.desc("_came"), F.desc(F.sha2("text", 256)), F.desc("section_title")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config = Config()) -> int:
    """Indexes what is new and returns the number of batches taken; ends when nothing new is left."""
    index = KeywordIndex(spark, output)
    taken: list[int] = []

    def take(rows: DataFrame, number: int) -> None:
        read = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("doc_id").isNull()).alias("without"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
        # A batch has a session of its own.
        with shuffles_for(rows.sparkSession, read["bytes"]), shuffles_for(spark, read["bytes"]):
            index.add(document_chunks(rows), number, newest())
        taken.append(number)
        own = F.col("batch") == number
        LOG.info("batch %d: read %d rows of %s (%d without a doc_id); wrote %d documents and %d rows of postings to %s", number, read["all"], documents, read["without"], index.all_chunks().where(own).count(), index.postings().where(own).count(), output)

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config.files_a_batch).parquet(documents)
    rows = stream.select("*", F.col("_metadata.file_modification_time").alias("_came"))
    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s holds %d documents after %d new batches", output, index.chunks().count(), len(taken))
    return len(taken)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Index new documents for keyword search.")
    parser.add_argument("documents")
    parser.add_argument("index")
    parser.add_argument("checkpoint")
    parser.add_argument("--config")
    args = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("keyword-index").getOrCreate()
    try:
        run(spark, args.documents, args.index, args.checkpoint, from_toml(Config, args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
