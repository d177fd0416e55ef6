"""Incremental ingestion: an extension of the batch run to a stream of document files.

Each micro-batch is one ingestion of its documents; as unchanged documents are
reused and changed ones replaced whole, a batch that is replayed after a failure
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery import schemas
from gleanery.operators.embedding import EmbeddingProvider
from gleanery.plans.ingestion import ingest
from gleanery.settings import Settings
from gleanery.sources.store import IndexStore


def document_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Documents that land as parquet files in a folder."""
    return spark.readStream.schema(schemas.struct(schemas.DOCUMENT)).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def start_ingestion(documents: DataFrame, store: IndexStore, settings: Settings, checkpoint: str, provider: EmbeddingProvider | None = None, once: bool = False) -> StreamingQuery:
    """Starts the stream; of a document that comes several times in a batch the one with the greatest digest counts, so that a replay takes the same."""
    store.initialize()

    def batch(rows: DataFrame, _: int) -> None:
        by = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("content_sha256"), F.desc("status"))
        ingest(rows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth"), store, settings, provider)

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
