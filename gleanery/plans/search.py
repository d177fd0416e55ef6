"""Search: channels, fusion, reranking and context behind one call, for batches of queries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.operators import retrieval as r
from gleanery.operators.context import expand
from gleanery.operators.embedding import EmbeddingProvider, embed_query, identity
from gleanery.operators.rerank import RerankerProvider, rerank
from gleanery.settings import Settings
from gleanery.sources.store import IndexStore

MODES = ("keyword", "semantic", "hybrid")
#: Candidates that a reranker gets at least.
RERANK_POOL = 200


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    note: str | None = None


def search(
    store: IndexStore,
    queries: Mapping[str, str] | str,
    mode: str = "hybrid",
    top_k: int | None = None,
    provider: EmbeddingProvider | None = None,
    reranker: RerankerProvider | None = None,
    expand_hierarchy: bool = False,
    settings: Settings = Settings(),
) -> SearchResult:
    """Ranked evidence of each query, with its chunk, source and scores.

    ``top_k`` is the setting of the mode unless given. If vectors can't be had, hybrid search goes on with
    keywords, and a note says so.
    """
    asked = {name: " ".join(query.split()) for name, query in ({"query": queries} if isinstance(queries, str) else queries).items()}
    if mode not in MODES:
        raise r.RetrievalError(f"the mode is one of {', '.join(MODES)}")
    given, limits = top_k, {"keyword": settings.keyword_top_k, "semantic": settings.semantic_top_k, "hybrid": settings.hybrid_top_k}
    top_k = limits[mode] if top_k is None else top_k
    if top_k <= 0 or not asked or not all(asked.values()):
        raise r.RetrievalError("a search has queries and a top_k above zero")
    spark, note = store.spark, None
    chunks = r.with_sources(store.table("chunks"), store.table("documents"))
    pool = max(top_k, RERANK_POOL) if reranker is not None and mode == "hybrid" else top_k
    # Without a limit of the call, each channel of a hybrid search has its own.
    own = {name: max(pool, limits[name]) if given is None and mode == "hybrid" else pool for name in ("keyword", "semantic")}
    near = None
    if mode != "keyword":
        try:
            if provider is None:
                raise r.RetrievalError("no embedding provider")
            vectors = r.compatible_vectors(chunks, store.table("embeddings"), identity(provider))
            near = r.no_hits(spark) if vectors.isEmpty() else r.semantic_search(vectors, embed_query(provider, asked, spark), own["semantic"])
        except Exception as error:
            if mode == "semantic":
                raise
            note = f"keyword results only ({type(error).__name__})"
    if mode == "semantic":
        hits = near
    elif mode == "keyword":
        hits = r.keyword_search(chunks, asked, own["keyword"])
    else:
        weights = {"semantic_weight": settings.hybrid_semantic_weight, "keyword_weight": settings.hybrid_keyword_weight}
        hits = r.fuse(r.keyword_search(chunks, asked, own["keyword"]), r.no_hits(spark) if near is None else near, pool, settings.hybrid_fusion_method, settings.rrf_k, **weights)
    found = r.evidence(hits, chunks)
    if mode == "hybrid":
        rows = spark.createDataFrame([(name, t.normal_form(query)) for name, query in asked.items()], "query_id string, query string")
        if reranker is not None and given is None:
            top_k = settings.reranker_top_k
        found = rerank(found, rows, reranker, top_k if reranker is not None else None)
    found = found.where(F.col("rank") <= top_k)
    if expand_hierarchy:
        found = expand(found, chunks, store.table("hierarchy_nodes"), settings.context_max_chunks, settings.context_max_characters)
    return SearchResult(found.orderBy("query_id", "rank"), note)
