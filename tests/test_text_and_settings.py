import math
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.settings import Settings, SettingsError
from gleanery.shipping import ship_package


def test_queries_are_normalized_and_split(spark):
    raw = "  ＰｏｓｔｇｒｅＳＱＬ\tMVCC  HTTP/2 C++ pg_catalog "
    assert t.normal_form(raw) == "postgresql mvcc http/2 c++ pg_catalog"
    ship_package(spark)
    rows = spark.createDataFrame([(0, raw), (1, "what is the cost of a vacuum and the vacuum"), (2, ""), (3, None)], "k int, q string")
    found = {r["k"]: r["terms"] for r in rows.select("k", t.terms(t.text_identity(F.col("q"))).alias("terms")).collect()}
    assert found == {0: ["postgresql", "mvcc", "http/2", "c++", "pg_catalog"], 1: ["cost", "vacuum"], 2: [], 3: None}


def test_folding(spark):
    rows = [(chr(k),) for k in range(0x20, 0x10000) if not 0xD800 <= k < 0xE000] + [("Straße",), ("ΣΊΣΥΦΟΣ",)]
    other = {r["c"] for r in spark.createDataFrame(rows, "c string").select("c", t.fold(F.col("c")).alias("f")).collect() if r["f"] != r["c"].casefold()}
    assert all(c in "ıẞ" or unicodedata.category(c) == "Cn" or len(c) == 1 and ord(c) in (0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC) or 0x13A0 <= ord(c) < 0x1400 or 0xAB70 <= ord(c) < 0xABC0 for c in other)


def test_columns_cut_text_as_python_does(spark):
    texts = ["", "a", "a\n", "a\r\nb\n\nc", "x\x0by\x1cz", "\n", "tab\tend. Next one! ok", "no end", " a  b "]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    found = {r["k"]: r for r in rows.select("k", t.lines(F.col("text")).alias("lines"), t.sentences(F.col("text")).alias("s"), t.squeeze(F.col("text")).alias("q"), t.token_count(F.col("text")).alias("n")).collect()}
    for k, text in enumerate(texts):
        assert found[k]["lines"] == text.splitlines()
        assert found[k]["q"] == " ".join(text.split())
    assert found[6]["s"] == ["tab\tend.", "Next one!", "ok"]
    assert found[6]["n"] == 7


def test_bounded_terms(spark):
    rows = spark.createDataFrame([("uses C++ well",), ("uses C++17",), ("mvcc",), ("xmvcc",), (None,), ("a_mvcc",), ("(mvcc)",)], "text string")
    assert [r[0] for r in rows.select(t.bounded_term(F.lower(F.coalesce("text", F.lit(""))), "c++")).collect()] == [True, False, False, False, False, False, False]
    assert [r[0] for r in rows.select(t.bounded_term(F.lower(F.coalesce("text", F.lit(""))), "mvcc")).collect()] == [False, False, True, False, False, False, True]


def test_hashes_keep_nulls_as_empty(spark):
    one = spark.range(1).select(t.sha256(F.lit("a"), F.lit(None).cast("string"), F.lit("b")).alias("h")).first()["h"]
    import hashlib

    assert one == hashlib.sha256("a\x1f\x1fb".encode()).hexdigest()


def test_text_identity_is_exact(spark):
    rows = spark.createDataFrame([("Straße  ＡＢ",), (None,)], "text string")
    assert [r[0] for r in rows.select(t.text_identity("text")).collect()] == ["strasse ab", None]


def test_settings():
    found = Settings.from_environment({}, "/tmp")
    assert (found.chunk_size, found.chunk_overlap, found.rrf_k, found.hybrid_semantic_weight) == (1000, 150, 60, 0.75)
    assert found.corpus_dir == Path("/tmp/data/corpus").resolve()
    other = Settings.from_environment({"GLEANERY_CHUNK_SIZE": "20", "GLEANERY_CHUNK_OVERLAP": "5", "GLEANERY_CHUNK_SIZE_UNIT": " Tokens ", "GLEANERY_RERANKER_PROVIDER": "", "GLEANERY_RERANKER_MODEL": ""}, "/tmp")
    assert (other.chunk_size, other.chunk_size_unit, other.reranker_model) == (20, "tokens", None)
    for bad in ({"CHUNK_OVERLAP": "1000"}, {"CHUNK_SIZE": "0"}, {"KEYWORD_TOP_K": "1.5"}, {"RRF_K": "x"}, {"HYBRID_FUSION_METHOD": "other"}, {"EMBEDDING_MODEL": ""}, {"HYBRID_SEMANTIC_WEIGHT": "nan"}, {"CORPUS_DIR": " "}):
        with pytest.raises(SettingsError):
            Settings.from_environment({f"GLEANERY_{k}": v for k, v in bad.items()}, "/tmp")
    with pytest.raises(SettingsError):
        Settings(hybrid_semantic_weight=0.0, hybrid_keyword_weight=0.0)
    assert math.isfinite(found.hybrid_keyword_weight)
