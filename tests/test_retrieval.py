import math
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery.operators import context, embedding, evaluation, rerank, retrieval as r

HIT = "query_id string, chunk_id string, document_id string, source_path string, sequence int, score double, rank int"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def chunks(spark):
    rows = [
        ("c1", "d1", "a.txt", 0, None, ["a.txt", "MVCC Basics"], "Plain words about rows.", "h1"),
        ("c2", "d1", "a.txt", 1, "Storage", ["a.txt"], "How MVCC works, and C++17.", "h2"),
        ("c3", "d2", "B.txt", 0, None, ["B.txt"], "xmvcc or mvcc_x are other names. C++ here.", "h3"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, source_path string, sequence int, section_title string, section_path array<string>, text string, content_hash string")


def test_keyword_scores(spark):
    found = r.keyword_search(chunks(spark), {"a": "What is MVCC", "b": "C++", "c": "the of", "d": "storage mvcc"}).collect()
    assert {(x["query_id"], x["chunk_id"]): (x["score"], x["rank"]) for x in found} == {("a", "c1"): (2.0, 1), ("a", "c2"): (1.0, 2), ("b", "c3"): (1.0, 1), ("d", "c2"): (3.0, 1), ("d", "c1"): (2.0, 2)}
    assert r.keyword_search(chunks(spark), {"c": "the"}).count() == 0
    with pytest.raises(r.RetrievalError):
        r.keyword_search(chunks(spark), {"a": "x"}, 0)


def test_a_table_of_queries_finds_the_same(spark):
    searches = {"a": "MVCC", "b": "c++ c++17", "c": "mvcc_x other", "d": "a.txt rows", "e": "is the"}
    table = spark.createDataFrame(list(searches.items()), "query_id string, query string")
    key = lambda rows: sorted((x["query_id"], x["chunk_id"], x["score"], x["rank"]) for x in rows.collect())
    assert key(r.keyword_search_table(chunks(spark), table)) == key(r.keyword_search(chunks(spark), searches))


def test_cosine_search(spark):
    model = r.ModelIdentity("p", "m", "1")
    records = [
        ("c1", "p", "m", "1", "h1", 2, [1.0, 0.0], None), ("c2", "p", "m", "1", "h2", 2, [0.0, 3.0], None), ("c3", "p", "m", "1", "old", 2, [1.0, 1.0], None),
        ("c3", "p", "m", "2", "h3", 2, [1.0, 1.0], None), ("c3", "p", "m", "1", "h3", 3, [1.0, 1.0, 1.0], None), ("c1", "q", "m", "1", "h1", 2, [9.0, 0.0], None),
    ]
    stored = spark.createDataFrame(records, "chunk_id string, provider_name string, model_name string, model_version string, content_hash string, dimension int, vector array<double>, created_at timestamp")
    vectors = r.compatible_vectors(chunks(spark), stored, model)
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<double>")
    assert [(x["chunk_id"], x["score"]) for x in r.semantic_search(vectors, asked).orderBy("rank").collect()] == [("c1", 1.0), ("c2", 0.0)]
    assert sorted(x[0] for x in r.compatible_dimensions(chunks(spark), stored, model).collect()) == [2, 3]
    with pytest.raises(r.RetrievalError):
        r.semantic_search(vectors, spark.createDataFrame([("q", [0.0, 0.0])], "query_id string, vector array<double>"))
    bad = [[], [float("nan")], [float("inf")], [None, 1.0]]
    rows = spark.createDataFrame([(x,) for x in bad] + [(None,), ([1.0],)], "v array<double>")
    assert [x[0] for x in rows.select(F.coalesce(r.valid_vector(F.col("v")), F.lit(False))).collect()] == [False] * 5 + [True]


def hits(spark, *rows):
    return spark.createDataFrame([("q", c, "d", f"{c}.txt", 0, float(s), k) for c, s, k in rows], HIT)


def test_fusion(spark):
    swapped = r.fuse(hits(spark, ("a", 5, 1), ("b", 4, 2)), hits(spark, ("b", 0.9, 1), ("a", 0.8, 2)), rrf_k=10).orderBy("rank").collect()
    assert [x["chunk_id"] for x in swapped] == ["b", "a"]
    assert all(math.isclose(x["score"], 1 / 11 + 1 / 12) for x in swapped)
    again = r.fuse(hits(spark, ("a", 5, 1), ("a", 4, 2), ("b", 3, 3)), hits(spark, ("a", 0.9, 2)), rrf_k=5, keyword_weight=2.0, semantic_weight=1.0).orderBy("rank").collect()
    assert math.isclose(again[0]["score"], 2 / 6 + 1 / 7)
    scaled = r.fuse(hits(spark, ("a", 4, 1), ("b", 2, 2)), hits(spark, ("b", 0.5, 1)), method="weighted_sum", keyword_weight=2.0, semantic_weight=1.0).orderBy("rank").collect()
    assert [(x["chunk_id"], x["score"]) for x in scaled] == [("a", 2.0), ("b", 1.0)]
    for bad in ({"method": "x"}, {"rrf_k": 0}, {"k": 0}, {"semantic_weight": -1.0}, {"semantic_weight": 0.0, "keyword_weight": 0.0}):
        with pytest.raises(r.RetrievalError):
            r.fuse(hits(spark), hits(spark), **bad)


class Broken:
    provider_name = model_name = model_version = "x"

    def score(self, query, texts):
        raise RuntimeError("no")


class Lengths:
    provider_name = model_name = model_version = "x"

    def score(self, query, texts):
        return [len(text) for text in texts]


def test_reranking(spark):
    found = r.evidence(hits(spark, ("c1", 3, 1), ("c2", 2, 2), ("c3", 1, 3)), chunks(spark))
    asked = spark.createDataFrame([("q", "mvcc")], "query_id string, query string")
    applied = rerank.rerank(found, asked, Lengths(), 2).orderBy("rank").collect()
    assert [(x["chunk_id"], x["rank"], x["rerank_status"]) for x in applied] == [("c3", 1, "applied"), ("c1", 2, "applied")]
    failed = rerank.rerank(found, asked, Broken(), 2).orderBy("rank").collect()
    assert [x["chunk_id"] for x in failed] == ["c1", "c2", "c3"]
    assert {(x["rerank_status"], x["rerank_reason"]) for x in failed} == {("failed", "reranking failed (RuntimeError)")}
    assert {x["rerank_status"] for x in rerank.rerank(found, asked).collect()} == {"skipped"}


def tree(spark):
    """A root with a section that holds a subsection; chunks hang on each and two on the section."""
    nodes = spark.createDataFrame([("d", "r", None, 0), ("d", "s", "r", 1), ("d", "u", "s", 2)], "document_id string, node_id string, parent_id string, sequence int")
    rows = [("k0", "d", "r", 0, "root text", None, "k1"), ("k1", "d", "s", 1, "first", "k0", "k2"), ("k2", "d", "s", 2, "second", "k1", "k3"), ("k3", "d", "u", 3, "below", "k2", None), ("k4", "d", "s", 9, "far", None, None)]
    return nodes, spark.createDataFrame(rows, "chunk_id string, document_id string, parent_id string, sequence int, text string, previous_chunk_id string, next_chunk_id string")


def test_context(spark):
    nodes, rows = tree(spark)
    assert {(x["node_id"], x["ancestor_id"], x["distance"]) for x in context.closure(nodes).collect()} == {("s", "r", 1), ("u", "s", 1), ("u", "r", 2)}
    asked = spark.createDataFrame([("q", "k1", 1)], "query_id string, chunk_id string, rank int")
    assert {(x["chunk_id"], x["relation"]) for x in context.relations(asked, rows, nodes).collect()} == {("k0", "parent"), ("k2", "neighbor"), ("k3", "child")}
    kept = lambda frame: [(x["chunk_id"], x["relation"]) for x in frame.first()["context"]]
    assert kept(context.expand(asked, rows, nodes, 5)) == [("k0", "parent"), ("k2", "neighbor"), ("k3", "child")]
    assert kept(context.expand(asked, rows, nodes, 5, 11)) == [("k0", "parent")]
    assert kept(context.expand(asked, rows, nodes, 5, 6)) == [("k2", "neighbor")]
    assert kept(context.expand(asked, rows, nodes, 0)) == []
    two = spark.createDataFrame([("q", "k1", 1), ("q", "k2", 2)], "query_id string, chunk_id string, rank int")
    found = {x["chunk_id"]: [c["chunk_id"] for c in x["context"]] for x in context.expand(two, rows, nodes, 1).collect()}
    assert found == {"k1": ["k0"], "k2": ["k3"]}


def test_metrics(spark):
    ranks = [("a", "x", 1), ("a", "n", 2), ("a", "y", 3), ("a", "x", 4), ("b", "1", 1), ("b", "2", 2), ("b", "3", 3), ("b", "4", 4), ("b", "5", 5), ("b", "x", 6), ("b", "7", 7)]
    rankings = spark.createDataFrame(ranks, "case_id string, item_id string, rank int")
    cases = spark.createDataFrame([("a", "", ["x", "y"], []), ("b", "", [], ["x", "z"]), ("c", "", ["q"], []), ("e", "", [], [])], "case_id string, query string, relevant_chunk_ids array<string>, relevant_document_ids array<string>")
    found = {x["case_id"]: x for x in evaluation.metrics(rankings, evaluation.relevant_items(cases), cases).collect()}
    assert math.isclose(found["a"]["ndcg_at_5"], (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))) and found["a"]["recall_at_5"] == 1.0
    assert (found["b"]["recall_at_5"], found["b"]["recall_at_10"]) == (0.0, 0.5) and math.isclose(found["b"]["mrr"], 1 / 6)
    assert found["c"]["mrr"] == found["e"]["ndcg_at_10"] == found["e"]["recall_at_20"] == 0.0
    means = evaluation.averages(evaluation.metrics(rankings, evaluation.relevant_items(cases), cases)).first()
    assert means["case_count"] == 4 and math.isclose(means["mrr"], (1 + 1 / 6) / 4)


class Picky(embedding.HashingProvider):
    def embed(self, texts):
        if any("bad" in text for text in texts):
            raise OSError("secret")
        return super().embed(texts)


def test_embedding(spark):
    rows = chunks(spark).withColumn("text", F.when(F.col("chunk_id") == "c2", "a bad one").otherwise(F.col("text")))
    provider = Picky(8)
    none = spark.createDataFrame([], "chunk_id string, provider_name string, model_name string, model_version string, content_hash string, dimension int, vector array<double>, created_at timestamp")
    records, failures = embedding.embed_chunks(rows, none, provider)
    assert [(x["chunk_id"], x["error"]) for x in failures.collect()] == [("c2", "OSError")]
    stored = spark.createDataFrame(records.collect(), none.schema)
    assert stored.count() == 2 and embedding.invalid_records(stored).count() == 0
    model = embedding.identity(provider)
    assert {x["chunk_id"] for x in embedding.missing(rows, stored, model).collect()} == {"c2"}
    assert {x["chunk_id"] for x in embedding.cached(rows, stored, model).collect()} == {"c1", "c3"}
    assert embedding.one_dimension(stored, model) == 8
    text = rows.where("chunk_id = 'c1'").select(embedding.embedding_input()).first()[0]
    assert text == "a.txt > MVCC Basics\n\nPlain words about rows."
    for bad in ([[1.0], [1.0, 2.0]], [[]], [[True]], [[float("nan")]], [[1.0]]):
        with pytest.raises(embedding.EmbeddingError):
            embedding.checked_vectors(bad, 2 if bad == [[1.0]] else len(bad), None)


def test_every_turn_is_expanded(spark, tmp_path):
    from gleanery.plans import catalog

    rows = [(1, turn, "user", f"text {turn}") for turn in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["chunk_id"]: (r["admitted"], r["relations"]) for r in catalog.ctx_expand(spark, str(tmp_path)).collect()}
    assert found == {
        "c1/0": ("c1/1,c1/2", "child,child"), "c1/1": ("c1/0,c1/2", "parent,neighbor"), "c1/2": ("c1/0,c1/1", "parent,neighbor"),
        "c1/3": ("c1/1,c1/0", "parent,parent"), "c1/4": ("c1/1,c1/0", "parent,parent"),
    }


def test_metrics_by_label_equal_those_of_pairs(spark):
    rows = [(f"i{k}", None if k == 7 else k % 3) for k in range(30)]
    labels = spark.createDataFrame(rows, "item_id string, label int")
    rankings = spark.createDataFrame([(f"i{c}", f"i{(c * 7 + k * k) % 30}", k + 1) for c in range(9) for k in range(25)], "case_id string, item_id string, rank int")
    cases = labels.limit(9).select(F.col("item_id").alias("case_id"))
    asked = cases.join(labels.withColumnRenamed("item_id", "case_id"), "case_id")
    want = evaluation.metrics(rankings, asked.join(labels, "label").select("case_id", "item_id"), cases)
    found = evaluation.label_metrics(rankings, labels, cases)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 9
