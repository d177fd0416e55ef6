"""Ingestion: documents to nodes, chunks and embeddings in a store, reusing what is unchanged."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators.chunking import chunk_trees, fingerprint, gathered
from gleanery.operators.embedding import EmbeddingProvider, embed_chunks
from gleanery.operators.hierarchy import HIERARCHY_VERSION, detect_hierarchy, hierarchy_warnings
from gleanery.settings import Settings
from gleanery.sizing import shuffles_for
from gleanery.sources.files import read_corpus
from gleanery.sources.store import IndexStore, broken_documents


#: Failures that a summary shows; the store has all of them.
SHOWN_FAILURES = 100


@dataclass(frozen=True)
class Summary:
    run_id: str
    status: str
    indexed: int
    unchanged: int
    chunks: int
    failures: tuple[tuple[str, str], ...]
    failure_count: int = 0
    unusable: int = 0

    @property
    def discovered(self) -> int:
        return self.indexed + self.unusable


def run_status(indexed: Column, failures: Column) -> Column:
    return F.when(failures == 0, "completed").when(indexed > 0, "partial").otherwise("failed")


def digest(prints: str) -> Column:
    """What makes a document's index stale: all that is known of it, each page by a digest of its own, and how it is split and chunked."""
    pages = F.transform("pages", lambda page: F.sha2(F.to_json(page), 256))
    known = F.struct("source_filename", "source_path", "content_sha256", "page_count", F.array_sort(F.map_entries("metadata")).alias("metadata"), "status", "warnings", "outlines", pages.alias("pages"))
    return F.sha2(F.concat_ws("|", F.lit(prints), F.lit(HIERARCHY_VERSION), F.to_json(known)), 256)


def changed_documents(documents: DataFrame, store: IndexStore, settings: Settings) -> DataFrame:
    """Documents, with their digest, that the store lacks or has with another one."""
    prints = fingerprint(settings.chunk_size, settings.chunk_overlap, settings.chunk_size_unit)
    same = store.table("documents").select("document_id", "digest")
    return documents.withColumn("digest", digest(prints)).join(same, ["document_id", "digest"], "left_anti")


def ingest(documents: DataFrame, store: IndexStore, settings: Settings, provider: EmbeddingProvider | None = None) -> Summary:
    """Indexes documents and records the run. Failures stay with their document or chunk, as rows of the store."""
    try:
        return _ingest(documents, store, settings, provider)
    finally:
        store.clear_staged()


def _ingest(documents: DataFrame, store: IndexStore, settings: Settings, provider: EmbeddingProvider | None) -> Summary:
    spark = documents.sparkSession
    started, run_id = datetime.now(UTC).replace(tzinfo=None), uuid.uuid4().hex
    usable = ~F.col("status").isin("unreadable", "encrypted") & (F.size("pages") > 0)
    size = F.aggregate("pages", F.lit(0).cast("long"), lambda sum_, page: sum_ + F.coalesce(F.octet_length(page["text"]), F.lit(0)))
    counts = documents.agg(F.count(F.lit(1)).alias("all"), F.count_if(usable).alias("usable"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    if not counts["all"]:
        return Summary(run_id, "empty", 0, 0, 0, ())
    # Texts are dealt by document several times; a batch of a stream has a session of its own.
    with shuffles_for(spark, counts["bytes"], cleaned=True), shuffles_for(store.spark, counts["bytes"], cleaned=True):
        return _indexed(documents, store, settings, provider, usable, counts, run_id, started)


def _indexed(documents: DataFrame, store: IndexStore, settings: Settings, provider: EmbeddingProvider | None, usable: Column, counts: Row, run_id: str, started: datetime) -> Summary:
    spark = documents.sparkSession
    store.initialize()
    nothing = F.lit(None).cast("string").alias("chunk_id")
    failures = [documents.where(~usable).select("source_path", F.col("status").alias("reason"), nothing)]
    good = documents.where(usable)
    # Written once: a second reading, run of the chunker or a model could end otherwise. Nothing is cached, and a text moves once.
    fresh = store.staged(changed_documents(good, store, settings))
    unchanged = counts["usable"] - fresh.count()
    good = store.staged(good.select("document_id", "source_path")) if unchanged else fresh.select("document_id", "source_path")
    if unchanged < counts["usable"]:
        nodes = detect_hierarchy(fresh.repartition("document_id"))
        trees = store.staged(gathered(nodes, tuple(name for name in nodes.columns if name != "document_id")), f"trees-{run_id}")
        made = {"hierarchy_nodes": store.prepare("hierarchy_nodes", trees.select("document_id", F.inline("nodes"))), "chunks": store.prepare("chunks", chunk_trees(trees, settings.chunk_size, settings.chunk_overlap, settings.chunk_size_unit))}
        store.clear_staged(f"trees-{run_id}")
        nodes, chunks = (store.prepared(name, paths) for name, paths in made.items())
        broken = broken_documents(fresh, nodes, chunks, store.staged).withColumnRenamed("problem", "reason")
        bad = store.staged(store.prepared_errors("chunks", made["chunks"]).withColumnRenamed("error", "reason").unionByName(broken).groupBy("document_id").agg(F.min("reason").alias("reason")))
        failures.append(fresh.join(bad, "document_id").select("source_path", "reason", nothing))
        whole = fresh.join(bad.select("document_id"), "document_id", "left_anti")
        if not whole.isEmpty():
            store.replace_prepared(whole, made, bad, hierarchy_warnings(whole, nodes))
        store.discard(made)
        good = good.join(bad.select("document_id"), "document_id", "left_anti")
    total = good.count()
    chunks = store.table("chunks")
    count = chunks.groupBy("document_id").count().join(good, "document_id", "left_semi").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    own = chunks.join(good, "document_id")
    if provider is not None:
        try:
            records, failed = embed_chunks(own.drop("source_path"), store.table("embeddings"), provider, settings, keep=store.staged)
            failures.append(failed.join(own.select("chunk_id", "source_path"), "chunk_id").select("source_path", F.col("error").alias("reason"), "chunk_id"))
            if not records.isEmpty():
                store.save_embeddings(records)
        except Exception as error:  # noqa: BLE001  without its vectors the index still serves keywords
            failures.append(own.select("source_path", F.lit(f"embeddings: {type(error).__name__}").alias("reason"), "chunk_id"))
    everything = failures[0]
    for more in failures[1:]:
        everything = everything.unionByName(more)
    failure_count = store.save_failures(run_id, everything)
    kept = store.failures(run_id)
    reasons = [row["reason"] for row in kept.select("reason").distinct().orderBy("reason").limit(SHOWN_FAILURES).collect()]
    shown = tuple((row["chunk_id"] or row["source_path"], row["reason"]) for row in kept.orderBy("source_path", "chunk_id").limit(SHOWN_FAILURES).collect())
    status = "completed" if not failure_count else "partial" if total else "failed"
    run = [(run_id, status, total, count, failure_count, started, datetime.now(UTC).replace(tzinfo=None), "; ".join(reasons) or None)]
    store.save_index_runs(spark.createDataFrame(run, schemas.struct(schemas.INDEX_RUN)))
    return Summary(run_id, status, total, unchanged, count, shown, failure_count, counts["all"] - counts["usable"])


def ingest_corpus(spark: SparkSession, settings: Settings, provider: EmbeddingProvider | None = None, pdf_reader=None) -> Summary:
    """Indexes the files of the configured corpus folder."""
    return ingest(read_corpus(spark, str(settings.corpus_dir), pdf_reader), IndexStore(spark, str(settings.store_dir)), settings, provider)
