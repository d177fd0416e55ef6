"""The jobs: growing input, new versions, reruns, and their queries against SQL."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gleanery import sizing
from gleanery.operators import postings
from gleanery.operators.postings import KeywordIndex
from jobs import keyword_index, queries, retrieval_report
from jobs.settings import from_toml

DATA = "/root/testdata/sf0.001"


def entries(index):
    return sorted(tuple(row) for row in index.entries().select("piece", "document_id", "points").collect())


def test_only_new_files_are_taken(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    arrived, output, mark = f"{tmp_path}/arrived", f"{tmp_path}/index", f"{tmp_path}/mark"
    docs.where("doc_id < 100").coalesce(1).write.parquet(arrived)
    assert keyword_index.run(spark, arrived, output, mark) == 1
    index = KeywordIndex(spark, output)
    first = entries(index)
    assert index.chunks().count() == 100
    assert keyword_index.run(spark, arrived, output, mark) == 0  # nothing new, nothing changed
    assert entries(index) == first
    docs.where("doc_id >= 100").repartition(2).write.mode("append").parquet(arrived)
    assert keyword_index.run(spark, arrived, output, mark, keyword_index.Config(files_a_batch=1)) == 2
    assert index.all_chunks().where("batch = 0").count() == 100
    # The same as an index of all at once.
    whole = f"{tmp_path}/whole"
    keyword_index.run(spark, arrived, whole, f"{tmp_path}/whole-mark")
    assert entries(index) == entries(KeywordIndex(spark, whole))


def test_new_versions_replace_old_ones(spark, tmp_path):
    ddl = "doc_id long, text string, lang string, source string, clash int"
    arrived, output, mark = f"{tmp_path}/arrived", f"{tmp_path}/index", f"{tmp_path}/mark"
    rows = [(1, "old words", "en", "s", 1), (2, "other words", "en", "s", 1), (3, None, None, None, None), (None, "no id", "en", "s", 1), (2, "other words", "en", "s", 1)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(arrived)
    keyword_index.run(spark, arrived, output, mark)
    spark.createDataFrame([(1, "new words", "en", "s", 2)], ddl).coalesce(1).write.mode("append").parquet(arrived)
    keyword_index.run(spark, arrived, output, mark)
    index = KeywordIndex(spark, output)
    assert sorted(row["body"] for row in index.chunks().collect()) == ["", "new words", "other words"]
    texts = {row["piece"] for row in index.entries().collect()}
    assert "new" in texts and "old" not in texts and "no" not in texts


def test_versions_of_a_batch_and_shuffles_of_its_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "TASK_BYTES", 2000)
    ddl = "doc_id long, text string, lang string, source string"
    arrived, seen = f"{tmp_path}/arrived", []
    rows = [(k % 40, f"word{k} " * 20, "en", "s") for k in range(120)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(arrived)
    own = KeywordIndex.add

    def add(index, chunks, *rest):
        seen.extend(int(x.conf.get(sizing.PARTITIONS)) for x in (chunks.sparkSession, index.spark))
        own(index, chunks, *rest)

    monkeypatch.setattr(KeywordIndex, "add", add)
    before = {name: spark.conf.get(name) for name in (sizing.PARTITIONS, sizing.ADVISORY)}
    keyword_index.run(spark, arrived, f"{tmp_path}/index", f"{tmp_path}/mark")
    assert {name: spark.conf.get(name) for name in before} == before
    size = sum(len(row[1]) for row in rows)
    assert seen == [-(-size // 2000)] * 2  # a task for each 2000 bytes, however large the input
    # One version of a document, that of the greatest digest, however they come.
    want = {k: max((row[1] for row in rows if row[0] == k), key=lambda text: hashlib.sha256(text.encode()).hexdigest()) for k in range(40)}
    index = KeywordIndex(spark, f"{tmp_path}/index")
    assert sorted(row["body"] for row in index.chunks().collect()) == sorted(want.values())
    assert {(row["piece"], row["points"]) for row in index.entries().where("piece like 'word%'").collect()} == {(text.split()[0], 1) for text in want.values()}


def test_no_entry_is_shuffled_by_itself(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "BLOCKS_OF_TASK", 2)
    index = KeywordIndex(spark, f"{tmp_path}/index")
    made = spark.range(40).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("p"), "id").alias("source_path"), F.lit(0).alias("sequence"), F.concat(F.lit("all w"), "id").alias("text"), F.lit("en").alias("section_title"), F.array(F.lit("s")).alias("section_path"))
    index.add(made, 0)
    index.add(made.where("id < 10").withColumn("text", F.concat(F.lit("all new w"), F.col("sequence"))), 1)
    found = index.entries()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("SortMergeJoin") and "block" in plan[plan.index("SortMergeJoin") :].splitlines()[0]
    assert found.rdd.getNumPartitions() == 7  # 50 chunks of both batches in tasks of 8
    got = {(row["piece"], row["chunk_id"]) for row in found.where("piece not in ('en', 's')").collect()}
    assert got == {("all", f"c{k}") for k in range(40)} | {("new", f"c{k}") for k in range(10)} | {("w0", f"c{k}") for k in range(10)} | {(f"w{k}", f"c{k}") for k in range(10, 40)}


def test_the_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, query in queries.QUERIES.items():
        found, want = query(spark, DATA), con.sql(queries.SQL[name])
        columns = sorted(found.columns)
        assert columns == sorted(want.columns)
        key = lambda rows: sorted(json.dumps([round(x, 6) if isinstance(x, float) else x for x in row]) for row in rows)
        assert key(found.select(*columns).collect()) == key(want.select(*columns).fetchall())


def test_a_report_is_written_again_as_it_was(spark, tmp_path):
    report, places = f"{tmp_path}/report", [f"{DATA}/documents.parquet", f"{DATA}/embeddings.parquet"]
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions")
    for k in (20, 20, 7):
        retrieval_report.run(spark, *places, report, retrieval_report.Config(hybrid_k=k))
        means = {row["method"]: row for row in spark.read.parquet(f"{report}/averages").collect()}
        assert sorted(means) == ["hybrid", "keyword", "semantic"]
        assert means["semantic"]["mrr"] == 1.0  # a vector is nearest to itself
    assert spark.read.parquet(f"{report}/cases").groupBy("method").count().where(F.col("count") != 2).count() == 0
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_report_builds_no_index(spark, tmp_path, monkeypatch):
    """It asks for few terms: an index would move and write all texts and pieces for them."""
    built = []
    monkeypatch.setattr(KeywordIndex, "add", lambda *args: built.append(args))
    retrieval_report.run(spark, f"{DATA}/documents.parquet", f"{DATA}/embeddings.parquet", f"{tmp_path}/report")
    assert not built and spark.read.parquet(f"{tmp_path}/report/cases").count() > 0


def test_settings_files(tmp_path):
    assert from_toml(keyword_index.Config, "jobs/keyword_index.toml") == keyword_index.Config()
    assert from_toml(retrieval_report.Config, "jobs/retrieval_report.toml") == retrieval_report.Config()
    bad = tmp_path / "bad.toml"
    for text in ("files = 1", 'files_a_batch = "1"', "files_a_batch = 0"):
        bad.write_text(text)
        with pytest.raises(ValueError):
            from_toml(keyword_index.Config, str(bad))
