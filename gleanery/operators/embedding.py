"""Embeddings of chunks: cache reuse, batched generation, retries and validation.

A provider has ``provider_name``, ``model_name``, ``model_version`` and
``embed(texts)``, which gives one vector a text, in order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.operators.retrieval import ModelIdentity, valid_vector
from gleanery.settings import Settings
from gleanery.shipping import ship_package


class EmbeddingError(ValueError):
    """A provider, or what it returned, can't be used."""


class EmbeddingProvider(Protocol):
    provider_name: str
    model_name: str
    model_version: str

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@dataclass(frozen=True)
class HashingProvider:
    """A deterministic stand-in without a model: signed counts of hashed words."""

    dimension: int = 64
    provider_name: str = "hashing"
    model_name: str = "words"
    model_version: str = "1"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * self.dimension
            for word in text.lower().split() or [""]:
                code = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                vector[code % self.dimension] += 1.0 if code >> 63 else -1.0
            out.append(vector)
        return out


class SentenceTransformerProvider:
    """Adapter of sentence-transformers models; the package must be installed on the executors."""

    provider_name = "sentence-transformers"

    def __init__(self, model_name: str, revision: str | None = None, device: str | None = None, model=None):
        self.model_name, self._revision, self._device, self._model = model_name, revision, device, model
        card = getattr(model, "model_card_data", None)
        self.model_version = getattr(card, "base_model_revision", None) or revision or "unversioned"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        if self._model is None:  # once a worker
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.model_name, revision=self._revision, device=self._device)
        return [[float(x) for x in row] for row in self._model.encode(list(texts), normalize_embeddings=False)]


def create_provider(settings: Settings) -> EmbeddingProvider:
    if settings.embedding_provider == "hashing":
        return HashingProvider()
    if settings.embedding_provider != "sentence-transformers":
        raise EmbeddingError(f"no such embedding provider: {settings.embedding_provider}")
    return SentenceTransformerProvider(settings.embedding_model, settings.embedding_model_version)


def identity(provider: EmbeddingProvider, settings: Settings | None = None) -> ModelIdentity:
    """The provider's identity; it must be the configured one."""
    found = ModelIdentity(provider.provider_name.strip(), provider.model_name.strip(), provider.model_version.strip())
    if settings is not None and (found.provider_name, found.model_name) != (settings.embedding_provider, settings.embedding_model):
        raise EmbeddingError("the provider isn't the configured one")
    return found


def embedding_input() -> Column:
    """Section path, trimmed and without blank parts, a blank line, and the text."""
    path = F.array_join(F.filter(F.transform("section_path", t.trim), lambda x: x != ""), " > ")
    return F.when(path != "", F.concat(path, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))


def cached(chunks: DataFrame, embeddings: DataFrame, model: ModelIdentity) -> DataFrame:
    """Chunks that have a vector of this model for their current text."""
    return chunks.join(embeddings.where(model.matches()).select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")


def missing(chunks: DataFrame, embeddings: DataFrame, model: ModelIdentity) -> DataFrame:
    return chunks.join(embeddings.where(model.matches()).select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


def checked_vectors(vectors: Sequence, count: int, dimension: int | None) -> list[list[float]]:
    """Vectors as floats: one a text, numeric, finite, not empty and of one dimension."""
    rows = [list(vector) for vector in vectors]
    if len(rows) != count:
        raise EmbeddingError("another number of vectors than texts")
    for row in rows:
        if not row or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in row):
            raise EmbeddingError("a vector that isn't of finite numbers")
        if len(row) != (dimension or len(rows[0])):
            raise EmbeddingError("vectors of different dimensions")
    return [[float(x) for x in row] for row in rows]


def generate(chunks: DataFrame, provider: EmbeddingProvider, batch_size: int = 32, max_retries: int = 1, dimension: int | None = None) -> DataFrame:
    """Per chunk: chunk_id, content_hash, vector and error (the class name of what failed, with a null vector).

    A batch that fails is tried again text by text, so that a bad text spoils no other.
    """
    if batch_size <= 0 or max_retries < 0:
        raise EmbeddingError("the batch size must be above zero and retries not negative")
    identity(provider)
    ship_package(chunks.sparkSession)

    def one(text: str) -> tuple[list[float] | None, str | None]:
        error = None
        for _ in range(max_retries + 1):
            try:
                return checked_vectors(provider.embed([text]), 1, dimension)[0], None
            except Exception as failure:  # noqa: BLE001  providers may raise anything; only the class is told
                error = type(failure).__name__
        return None, error

    def run(batches):
        import pandas as pd

        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                texts = part["_input"].tolist()
                try:
                    found = [(vector, None) for vector in checked_vectors(provider.embed(texts), len(texts), dimension)]
                except Exception:  # noqa: BLE001
                    found = [one(text) for text in texts]
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "content_hash": part["content_hash"].to_numpy(), "vector": [v for v, _ in found], "error": [e for _, e in found]})

    return chunks.select("chunk_id", "content_hash", embedding_input().alias("_input")).mapInPandas(run, "chunk_id string, content_hash string, vector array<double>, error string")


def as_records(generated: DataFrame, model: ModelIdentity, created_at: Column | None = None) -> DataFrame:
    """Generated vectors as embedding records."""
    return generated.where("error is null").select(
        "chunk_id", F.lit(model.provider_name).alias("provider_name"), F.lit(model.model_name).alias("model_name"), F.lit(model.model_version).alias("model_version"),
        "content_hash", F.size("vector").alias("dimension"), "vector", (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def one_dimension(embeddings: DataFrame, model: ModelIdentity) -> int | None:
    """The dimension of a model's vectors, of which there may be one only."""
    row = embeddings.where(model.matches()).agg(F.min("dimension").alias("low"), F.max("dimension").alias("high")).first()
    if row["low"] != row["high"]:
        raise EmbeddingError("one model has vectors of different dimensions")
    return row["low"]


def embed_chunks(chunks: DataFrame, embeddings: DataFrame, provider: EmbeddingProvider, settings: Settings | None = None, batch_size: int = 32, max_retries: int = 1, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, DataFrame]:
    """New records for the chunks without a cached vector, and failures (chunk_id, error).

    ``keep`` holds what the provider made, so that each text is embedded once. All vectors
    of a run have the stored ones' dimension, or without any the one most of them have;
    others fail.
    """
    model = identity(provider, settings)
    known = one_dimension(embeddings, model)
    made = keep(generate(missing(chunks, embeddings, model), provider, batch_size, max_retries, known))
    if known is None:
        sizes = made.where("error is null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(2).collect()
        if len(sizes) > 1:
            other = F.col("error").isNull() & (F.size("vector") != sizes[0]["size"])
            made = made.withColumn("error", F.when(other, EmbeddingError.__name__).otherwise(F.col("error")))
    return as_records(made, model), made.where("error is not null").select("chunk_id", "error")


def invalid_records(embeddings: DataFrame) -> DataFrame:
    """Records with an empty name, a wrong dimension or an unusable vector."""
    blank = F.lit(False)
    for name in ("chunk_id", "provider_name", "model_name", "model_version"):
        blank = blank | (t.trim(F.coalesce(name, F.lit(""))) == "")
    return embeddings.where(blank | F.col("content_hash").isNull() | ~valid_vector(F.col("vector")) | (F.size("vector") != F.col("dimension")))


def embed_query(provider: EmbeddingProvider, queries: dict[str, str], spark, normalize: Callable[[str], str] = t.normal_form) -> DataFrame:
    """Query vectors (query_id, vector) of a driver-side set of queries."""
    names = list(queries)
    vectors = checked_vectors(provider.embed([normalize(queries[name]) for name in names]), len(names), None) if names else []
    return spark.createDataFrame(list(zip(names, vectors)), "query_id string, vector array<double>")
