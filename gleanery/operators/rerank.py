"""Reranking of candidates by a provider's scores.

A provider has the three identity strings and ``score(query, texts)``, one number
(or a row whose last element counts) for each text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.settings import Settings
from gleanery.shipping import ship_package

APPLIED, SKIPPED, FAILED = "applied", "skipped", "failed"


class RerankerProvider(Protocol):
    provider_name: str
    model_name: str
    model_version: str

    def score(self, query: str, texts: Sequence[str]) -> Sequence[float]: ...


@dataclass(frozen=True)
class LexicalReranker:
    """A deterministic stand-in: the share of the query's words that a text has."""

    provider_name: str = "lexical"
    model_name: str = "overlap"
    model_version: str = "1"

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        words = set(query.split())
        return [len(words & set(t.normal_form(text).split())) / max(1, len(words)) for text in texts]


class CrossEncoderReranker:
    """Adapter of sentence-transformers cross-encoders; the package must be installed on the executors."""

    provider_name = "sentence-transformers-cross-encoder"

    def __init__(self, model_name: str, revision: str | None = None, model=None):
        self.model_name, self._revision, self._model = model_name, revision, model
        self.model_version = revision or "unversioned"

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        if self._model is None:
            from sentence_transformers import CrossEncoder

            self._model = CrossEncoder(self.model_name, revision=self._revision)
        return [float(x[-1]) if hasattr(x, "__len__") else float(x) for x in self._model.predict([(query, text) for text in texts])]


def create_reranker(settings: Settings) -> RerankerProvider | None:
    if settings.reranker_provider is None:
        return None
    if settings.reranker_provider == "lexical":
        return LexicalReranker()
    if settings.reranker_provider != CrossEncoderReranker.provider_name:
        raise ValueError(f"no such reranker: {settings.reranker_provider}")
    return CrossEncoderReranker(settings.reranker_model, settings.reranker_model_version)


def candidate_text() -> Column:
    """Section path, a blank line and the text, as scored."""
    path = F.array_join("section_path", " > ")
    return F.when(path != "", F.concat(path, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))


def reranked(scored: DataFrame, k: int | None) -> DataFrame:
    """Candidates with a reranker_score in its order; a query without all of its scores keeps its order, whole."""
    whole = Window.partitionBy("query_id")
    usable = F.col("reranker_score").isNotNull() & ~F.isnan("reranker_score") & (F.abs("reranker_score") < float("inf"))
    applied = F.min(usable).over(whole)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("_applied"), F.col("reranker_score"))), "rank", F.lower("source_path"), "document_id", "sequence", "chunk_id")
    rows = scored.withColumn("_applied", applied).withColumn("_rank", F.row_number().over(order))
    kept = rows if k is None else rows.where(~F.col("_applied") | (F.col("_rank") <= k))
    return kept.withColumn("rank", F.when(F.col("_applied"), F.col("_rank")).otherwise(F.col("rank"))).withColumn("rerank_status", F.when(F.col("_applied"), APPLIED).otherwise(FAILED)).withColumn("reranker_score", F.when(F.col("_applied"), F.col("reranker_score"))).drop("_applied", "_rank")


def rerank(candidates: DataFrame, queries: DataFrame, reranker: RerankerProvider | None = None, k: int | None = None) -> DataFrame:
    """Candidates (hits with their chunks) reordered within each query, with reranker_score, rerank_status and rerank_reason.

    Without a reranker the order stays and the status is ``skipped``; if scoring a
    query fails, its order stays, the status is ``failed`` and the reason names the
    error's class. A query's candidates are few by construction (the top k) and are
    scored in one call.
    """
    if k is not None and k <= 0:
        raise ValueError("k must be above zero")
    if reranker is None:
        return candidates.withColumn("reranker_score", F.lit(None).cast("double")).withColumn("rerank_status", F.lit(SKIPPED)).withColumn("rerank_reason", F.lit("no reranker is configured"))
    ship_package(candidates.sparkSession)

    def score(group):
        import pandas as pd

        group = group.sort_values(["rank", "chunk_id"])
        query, reason, scores = t.normal_form(group["query"].iloc[0] or ""), None, [None] * len(group)
        if not query:
            reason = "the query is empty"
        else:
            try:
                found = [float(x) for x in reranker.score(query, group["_text"].tolist())]
                if len(found) != len(group) or not all(map(math.isfinite, found)):
                    raise ValueError("scores that can't be used")
                scores = found
            except Exception as error:  # noqa: BLE001  providers may raise anything
                reason = f"reranking failed ({type(error).__name__})"
        return pd.DataFrame({"query_id": group["query_id"], "chunk_id": group["chunk_id"], "reranker_score": pd.Series(scores, index=group.index, dtype="float64"), "rerank_reason": reason})

    asked = candidates.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "chunk_id", "rank", candidate_text().alias("_text"))
    scores = asked.groupBy("query_id").applyInPandas(score, "query_id string, chunk_id string, reranker_score double, rerank_reason string")
    return reranked(candidates.join(scores, ["query_id", "chunk_id"], "left"), k)
