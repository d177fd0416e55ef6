"""Keyword, vector and fused retrieval for batches of queries.

Chunks carry source_path and source_filename (an inner join with the documents).
Results have one row a query and hit. Scores come first, from the columns they
need; a window then keeps the top of each query, limited in every task before the
shuffle, and only those rows get the wide columns of their chunks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.functions.numbers import compensated_rows, compensated_sum
from gleanery.operators.postings import POINTS, KeywordIndex, searched_fields
from gleanery.operators.postings import search as search_postings
from gleanery.shipping import ship_package

#: Rank of a hit that a channel lacks.
NO_RANK = 2**31
#: Literal queries whose terms are one expression; more go through an index.
MOST_QUERIES = 200
#: Query vectors that are multiplied at a time.
QUERY_BLOCK = 512
#: Rows of vectors that are multiplied with a block of queries at a time.
ROW_BLOCK = 2048
#: How far a product of blocks can be from its compensated sum, at unit length.
ROUGH = 1e-12
#: Pairs that get compensated sums at a time.
SCORED = 50_000
#: Values of query vectors that are sent to every task at a time (64 MB).
QUERY_VALUES = 8_000_000


class RetrievalError(ValueError):
    """A query or parameter can't be used."""


def _above_zero(name: str, value: int) -> None:
    if value <= 0:
        raise RetrievalError(f"{name} must be above zero")


def with_sources(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the name and path of their document."""
    return chunks.join(documents.select("document_id", "source_filename", "source_path"), "document_id")


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their rank, from 1."""
    by = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def keyword_score(terms: Sequence[str], fields: Mapping[str, tuple[Column, float]]) -> Column:
    """1 for each term in the text, 2 for each in the title and 2 for each in the path; ``fields`` are in lower case."""
    score = F.lit(0.0)
    for term in terms:
        for column, points in fields.values():
            score = score + F.when(t.bounded_term(column, term), points).otherwise(0.0)
    return score


def keyword_search(chunks: DataFrame, queries: Mapping[str, str], k: int = 20) -> DataFrame:
    """The ``k`` best chunks of each query by its distinct terms: query_id, chunk_id, document_id, source_path, sequence, score, rank.

    The terms of a few queries become constants of one pass over the chunks; more queries go through an index.
    """
    _above_zero("k", k)
    spark = chunks.sparkSession
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    if len(queries) > MOST_QUERIES:
        return keyword_search_table(chunks, asked, k)
    ship_package(spark)
    found = asked.select("query_id", t.terms(t.text_identity(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    terms = {row["query_id"]: row["terms"] for row in found.collect()}
    columns = ("chunk_id", "document_id", "source_path", "sequence")
    if not terms:
        return chunks.where("false").select(F.lit("").alias("query_id"), *columns, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    # Lower case is made once for all terms, and scores are compiled columns.
    lowered = chunks.select(*columns, *(column.alias(f"_{name}") for name, column in searched_fields().items()))
    fields = {name: (F.col(f"_{name}"), float(POINTS[name])) for name in POINTS}
    each = lowered.select(*columns, *(keyword_score(found, fields).alias(f"_s{k}") for k, found in enumerate(terms.values())))
    scores = F.array(*(F.struct(F.lit(name).alias("query_id"), F.col(f"_s{k}").alias("score")) for k, name in enumerate(terms)))
    scored = each.select(*columns, F.inline(F.filter(scores, lambda x: x["score"] > 0)))
    return top(scored, k, F.desc("score"), t.fold(F.col("source_path")), F.asc("sequence"), F.asc("chunk_id"))


def keyword_search_table(chunks: DataFrame | KeywordIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """Keyword search for a table of queries (query_id, query) of any size: see ``postings``.

    Of chunks that aren't indexed, the terms of the queries are gathered in a folder of their own.
    """
    _above_zero("k", k)
    ship_package(queries.sparkSession)
    return search_postings(chunks, queries.select("query_id", t.terms(t.text_identity(F.col("query"))).alias("terms")), k)


def valid_vector(vector: Column) -> Column:
    """Whether a vector has elements and all are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


@dataclass(frozen=True)
class ModelIdentity:
    provider_name: str
    model_name: str
    model_version: str

    def __post_init__(self) -> None:
        if not all(isinstance(x, str) and x.strip() for x in (self.provider_name, self.model_name, self.model_version)):
            raise RetrievalError("a provider has a name, a model and a version")

    def matches(self) -> Column:
        return (F.col("provider_name") == self.provider_name) & (F.col("model_name") == self.model_name) & (F.col("model_version") == self.model_version)


def compatible_vectors(chunks: DataFrame, embeddings: DataFrame, model: ModelIdentity, dimension: int | None = None) -> DataFrame:
    """Chunk keys with the vectors of one model that belong to their current text."""
    own = embeddings.where(model.matches())
    if dimension is not None:
        own = own.where(F.col("dimension") == dimension)
    keys = chunks.select("chunk_id", "content_hash", "document_id", "source_path", "sequence")
    return keys.join(own.select("chunk_id", "content_hash", "dimension", "vector"), ["chunk_id", "content_hash"])


def compatible_dimensions(chunks: DataFrame, embeddings: DataFrame, model: ModelIdentity) -> DataFrame:
    return compatible_vectors(chunks, embeddings, model).select("dimension").distinct()


def norm(vector: Column) -> Column:
    return F.sqrt(compensated_sum(F.transform(vector, lambda x: x * x)))


def dot(left: Column, right: Column) -> Column:
    return compensated_sum(F.zip_with(left, right, lambda x, y: x * y))


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 20, query_values: int = QUERY_VALUES) -> DataFrame:
    """The ``k`` chunks nearest to each query vector by cosine: an exact scan.

    ``queries`` (query_id, vector) is a stated set. It is sent to every task in parts
    of ``query_values`` numbers, and chunks are read once a part. A task multiplies
    blocks of both and hands on the ``k`` best of each query. What comes near these gets a compensated sum, so that
    scores and ranks don't depend on blocks or tasks. Stored vectors that are invalid, of
    length zero or of another dimension are left out; a query vector mustn't be.
    """
    _above_zero("k", k)
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    state = asked.agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid_vector(F.col("vector")) | (norm(F.col("vector")) == 0)).alias("bad"), F.sum(F.size("vector")).alias("values")).first()
    if state["bad"]:
        raise RetrievalError("a query vector has no direction")
    keys = vectors.select("chunk_id", "document_id", "source_path", "sequence", F.col("vector").cast("array<double>").alias("vector"))
    parts = max(1, math.ceil((state["values"] or 0) / query_values))
    dealt = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = None
    for part in range(parts):
        own = _nearest(keys, dealt.where(F.col("_part") == part).drop("_part"), k)
        found = own if found is None else found.unionByName(own)
    return top(found, k, F.desc("score"), t.fold(F.col("source_path")), F.asc("sequence"), F.asc("chunk_id"))


class NearestRows:
    """The ``k`` best rows of each query among those that pass by, with the ties that order decides.

    Pairs are held as numbers (query, row, score), and the keys of a row once, however many queries it is near to.
    """

    ORDER = [("_order", "ascending"), ("sequence", "ascending"), ("chunk_id", "ascending")]

    def __init__(self, vectors: np.ndarray, k: int):
        self.units, self.k = vectors / np.sqrt(compensated_rows(vectors * vectors))[:, None], k
        self.least = np.full(len(vectors), -np.inf)
        self.keys: list = []  # tables, whose rows are numbered through
        self.rows = 0
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def pass_by(self, rows, vectors: np.ndarray) -> None:
        """``rows`` are a record batch with the vectors' keys."""
        for first in range(0, len(vectors), ROW_BLOCK):
            self._pass_block(rows.slice(first, ROW_BLOCK), vectors[first : first + ROW_BLOCK])

    def _pass_block(self, rows, vectors: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            length = np.sqrt(compensated_rows(vectors * vectors))
        good = np.flatnonzero(np.isfinite(vectors).all(1) & (length > 0) & np.isfinite(length))
        units = vectors[good] / length[good, None]
        rows = rows.take(_array(good))
        self.number = np.full(len(good), -1)  # of the block's rows among all held ones
        for first in range(0, len(self.units), QUERY_BLOCK):
            rough = self.units[first : first + QUERY_BLOCK] @ units.T
            least = self.least[first : first + QUERY_BLOCK]
            if len(good) > self.k:
                least = np.maximum(least, np.partition(rough, len(good) - self.k, axis=1)[:, len(good) - self.k])
            which, row = np.nonzero(rough >= least[:, None] - ROUGH)
            for at in range(0, len(which), SCORED):
                self._keep(rows, row[at : at + SCORED], first + which[at : at + SCORED], units)

    def _keep(self, rows, at: np.ndarray, queries: np.ndarray, units: np.ndarray) -> None:
        scores = np.clip(compensated_rows(self.units[queries] * units[at]), -1.0, 1.0)
        new = np.unique(at[self.number[at] < 0])
        if len(new):
            import pyarrow as pa

            self.keys.append(pa.Table.from_batches([rows.take(_array(new))]))
            self.number[new] = self.rows + np.arange(len(new))
            self.rows += len(new)
        self.pairs.append((queries.astype(np.int32), self.number[at].astype(np.int32), scores))
        self.count += len(at)
        if self.count > 2 * self.k * len(self.units) + SCORED:
            self._cut()

    def _cut(self) -> None:
        """Cuts what is held down to the best, in order, and drops the keys of other rows."""
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.concat_tables(self.keys).combine_chunks()
        place = np.empty(self.rows, dtype=np.int32)
        place[pc.sort_indices(table, sort_keys=self.ORDER).to_numpy()] = np.arange(self.rows, dtype=np.int32)
        queries, row, scores = (np.concatenate(part) for part in zip(*self.pairs))
        order = np.lexsort((place[row], -scores, queries))
        queries, row, scores = queries[order], row[order], scores[order]
        nth = np.arange(len(queries)) - np.searchsorted(queries, queries)
        best = nth < self.k
        queries, row, scores, nth = queries[best], row[best], scores[best], nth[best]
        self.least[queries[nth == self.k - 1]] = scores[nth == self.k - 1]
        used, row = np.unique(row, return_inverse=True)
        again = np.full(self.rows, -1)
        again[used] = np.arange(len(used))
        held = self.number >= 0
        self.number[held] = again[self.number[held]]
        self.keys, self.rows = [table.take(_array(used))], len(used)
        self.pairs, self.count = [(queries, row.astype(np.int32), scores)], len(queries)

    def found(self, size: int):
        """The best rows in parts of at most ``size``: numbers of queries, a table of keys, scores."""
        if self.pairs:
            self._cut()
            (queries, row, scores), (table,) = self.pairs[0], self.keys
            for first in range(0, len(queries), size):
                part = slice(first, first + size)
                yield queries[part], table.take(_array(row[part])), scores[part]


def _array(values: np.ndarray):
    import pyarrow as pa

    return pa.array(values)


def _nearest(keys: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each task for each query."""
    spark = keys.sparkSession
    ship_package(spark)
    groups: dict[int, tuple[list, list]] = {}
    for row in queries.collect():  # a part of the stated set, of checked size
        ids, rows = groups.setdefault(len(row["vector"]), ([], []))
        ids.append(row["query_id"])
        rows.append(row["vector"])
    shared = spark.sparkContext.broadcast({size: (ids, np.array(rows)) for size, (ids, rows) in groups.items()})
    kind = queries.schema["query_id"].dataType.simpleString()
    fields = {field.name: field.dataType.simpleString() for field in keys.schema if field.name != "vector"}
    schema = f"query_id {kind}, " + ", ".join(f"{name} {of}" for name, of in fields.items()) + ", score double"

    def run(batches):
        import pyarrow as pa

        state = {size: NearestRows(vectors, k) for size, (_, vectors) in shared.value.items()}
        for batch in batches:
            column = batch.column(batch.schema.names.index("vector"))
            lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, np.diff(column.offsets.to_numpy()))
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            rows = batch.drop_columns(["vector"])
            for size, nearest in state.items():
                at = np.flatnonzero(lengths == size)
                if len(at) and size:
                    nearest.pass_by(rows.take(pa.array(at)), values[offsets[at][:, None] + np.arange(size)])
        for size, nearest in state.items():
            ids = shared.value[size][0]
            for asked, rows, scores in nearest.found(10_000):
                columns = [pa.array([ids[q] for q in asked.tolist()]), *(rows.column(name) for name in fields), pa.array(scores)]
                yield from pa.table(columns, names=["query_id", *fields, "score"]).combine_chunks().to_batches()

    return keys.withColumn("_order", t.fold(F.col("source_path"))).mapInArrow(run, schema)


def deduplicate(hits: DataFrame) -> DataFrame:
    """Of each query's hits of one chunk the best: smallest rank, then largest score, path, sequence."""
    by = Window.partitionBy("query_id", "chunk_id").orderBy("rank", F.desc("score"), t.fold(F.col("source_path")), "sequence")
    return hits.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")


def normalized_score() -> Column:
    """Scores scaled to 0 to 1 within each query; 1 where all are equal."""
    by = Window.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    close = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(close, F.lit(1.0)).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = 10, method: str = "rrf", rrf_k: int = 60, semantic_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """One ranking of each query from both channels, by reciprocal ranks or weighted scores."""
    _above_zero("k", k)
    _above_zero("rrf_k", rrf_k)
    if method not in ("rrf", "weighted_sum"):
        raise RetrievalError("the method is rrf or weighted_sum")
    weights = (semantic_weight, keyword_weight)
    if not all(math.isfinite(x) and x >= 0 for x in weights) or not any(weights):
        raise RetrievalError("weights are finite, not negative, and not both zero")
    channels = []
    for hits, weight in ((keyword, keyword_weight), (semantic, semantic_weight)):
        own, factor = deduplicate(hits), F.lit(float(weight))
        channels.append(own.withColumn("scaled", factor * normalized_score() if method == "weighted_sum" else factor / (F.lit(float(rrf_k)) + F.col("rank"))))
    left, right = (hits.select("query_id", "chunk_id", *(F.col(c).alias(f"{name}_{c}") for c in ("document_id", "source_path", "sequence", "score", "rank", "scaled"))) for name, hits in zip(("keyword", "semantic"), channels))
    both = left.join(right, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce("keyword_scaled", F.lit(0.0)) + F.coalesce("semantic_scaled", F.lit(0.0))
    found = both.select("query_id", "chunk_id", *(F.coalesce(f"semantic_{c}", f"keyword_{c}").alias(c) for c in ("document_id", "source_path", "sequence")), score.alias("score"), "keyword_score", "semantic_score", "keyword_rank", "semantic_rank")
    ranks = [F.coalesce(name, F.lit(NO_RANK)) for name in ("semantic_rank", "keyword_rank")]
    return top(found, k, F.desc("score"), F.least(*ranks), *ranks, t.fold(F.col("source_path")), F.asc("document_id"), F.asc("sequence"), F.asc("chunk_id")).withColumn("hybrid_score", F.col("score"))


def hybrid_search(chunks: DataFrame, queries: Mapping[str, str], vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, keyword_k: int = 20, semantic_k: int = 20, **fusion) -> DataFrame:
    """Keyword hits, with those of the vectors where there are any, in one ranking."""
    words = keyword_search(chunks, queries, keyword_k)
    near = words.where("false") if vectors is None else semantic_search(vectors, query_vectors, semantic_k)
    return fuse(words, near, **fusion)


def evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with all columns of their chunks."""
    return hits.join(chunks.drop("document_id", "source_path", "sequence"), "chunk_id")


def no_hits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id string, chunk_id string, document_id string, source_path string, sequence int, score double, rank int")
