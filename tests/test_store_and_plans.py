import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery import schemas, sizing
from gleanery.operators import chunking, embedding, hierarchy, rerank
from gleanery.plans import catalog, evaluate, ingestion, search
from gleanery.settings import Settings
from gleanery.sources import files, store as s
from gleanery.streaming import incremental

SETTINGS = dict(chunk_size=60, chunk_overlap=10, embedding_provider="hashing", embedding_model="words")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "b.txt").write_text("CHAPTER 1\nMVCC keeps row versions. Vacuum removes old ones.\n\nReaders never block.", encoding="utf-8")
    (root / "sub" / "A.TXT").write_bytes(b"\xef\xbb\xbfIndexes speed up search in large tables of rows.")
    (root / "broken.txt").write_bytes(b"\xff\xfe\x00bad")
    (root / "empty.txt").write_text("  \n", encoding="utf-8")
    (root / "note.md").write_text("not a document", encoding="utf-8")
    return root


def test_files(spark, corpus):
    found = files.discover(spark, str(corpus))
    assert [r["source_path"] for r in found.collect()] == ["b.txt", "broken.txt", "empty.txt", "sub/A.TXT"]
    docs = {r["source_path"]: r for r in files.read_corpus(spark, str(corpus), lambda _: None).collect()}
    assert {k: v["status"] for k, v in docs.items()} == {"b.txt": "extracted", "broken.txt": "unreadable", "empty.txt": "empty", "sub/A.TXT": "extracted"}
    assert docs["sub/A.TXT"]["pages"][0]["text"].startswith("Indexes") and docs["broken.txt"]["content_sha256"] is None
    import hashlib

    assert docs["b.txt"]["document_id"] == hashlib.sha256(b"b.txt").hexdigest()
    with pytest.raises(files.CorpusError):
        files.discover(spark, str(corpus / "missing"))


class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        if self.text is None:
            raise ValueError
        return self.text


class Pdf:
    is_encrypted = False
    metadata = {"/Title": "T", "/CreationDate": "now"}

    def __init__(self, content):
        if content.startswith(b"no"):
            raise ValueError
        self.pages = [Page("a page with quite enough text"), Page(None), Page("tiny")]
        entry = type("Entry", (), {"title": " One "})()
        self.outline = [entry, [type("Entry", (), {"title": "Two"})(), type("Entry", (), {"title": ""})()]]

    def get_destination_page_number(self, entry):
        return 0


def test_pdf(spark):
    rows = spark.createDataFrame([("x.pdf", "x.pdf", bytearray(b"ok")), ("y.pdf", "y.pdf", bytearray(b"no"))], "source_path string, source_filename string, content binary")
    found = {r["source_path"]: r for r in files.pdf_documents(rows, Pdf).collect()}
    one = found["x.pdf"]
    assert (one["status"], one["page_count"], one["metadata"]["title"], one["metadata"]["creation_date"]) == ("partial", 3, "T", "now")
    assert [(o["title"], o["level"], o["order"]) for o in one["outlines"]] == [("One", 0, 0), ("Two", 1, 1)]
    assert one["warnings"] == ["outline_item_missing_title", "page_2_text_extraction_failed", "page_2_no_extractable_text", "page_3_little_extractable_text"]
    assert (found["y.pdf"]["status"], found["y.pdf"]["warnings"]) == ("unreadable", ["pdf_parse_failed"])


def indexed(spark, corpus, path):
    docs = files.read_corpus(spark, str(corpus), lambda _: None)
    held = s.IndexStore(spark, str(path), 4)
    return docs, held, ingestion.ingest(docs, held, Settings(**SETTINGS), embedding.HashingProvider())


def test_ingestion_is_incremental_and_search_finds(spark, corpus, tmp_path):
    docs, held, first = indexed(spark, corpus, tmp_path / "store")
    assert (first.status, first.indexed, first.unchanged, first.failures) == ("partial", 3, 0, (("broken.txt", "unreadable"),))
    assert held.statistics().first().asDict() == {"documents": 3, "chunks": first.chunks, "failures": 0}
    again = ingestion.ingest(docs, held, Settings(**SETTINGS), embedding.HashingProvider())
    assert (again.unchanged, again.chunks) == (3, first.chunks)
    (corpus / "b.txt").write_text("CHAPTER 1\nNothing but new words about vacuum here.", encoding="utf-8")
    third = ingestion.ingest(files.read_corpus(spark, str(corpus), lambda _: None), held, Settings(**SETTINGS), embedding.HashingProvider())
    assert third.unchanged == 2
    assert held.table("embeddings").count() == held.table("chunks").count()
    assert held.table("index_runs").count() == 3
    # A warning or a page that changes is found though the content's hash is the same; what is the same writes nothing.
    now = files.read_corpus(spark, str(corpus), lambda _: None).where("status <> 'unreadable'")
    settings = Settings(**SETTINGS)
    assert ingestion.changed_documents(now, held, settings).count() == 0
    pages = F.transform("pages", lambda p: p.withField("text", F.concat(p["text"], F.lit(" more"))))
    for changed in (now.withColumn("warnings", F.array(F.lit("new"))), now.withColumn("pages", pages), now.withColumn("metadata", F.create_map(F.lit("title"), F.lit("T")))):
        assert ingestion.changed_documents(changed, held, settings).count() == 3
    files_before = sorted(str(x) for x in (tmp_path / "store" / "data" / "chunks").rglob("*.parquet"))
    assert ingestion.ingest(now, held, settings).unchanged == 3
    assert sorted(str(x) for x in (tmp_path / "store" / "data" / "chunks").rglob("*.parquet")) == files_before
    found = search.search(held, "vacuum", "hybrid", 3, embedding.HashingProvider(), rerank.LexicalReranker(), expand_hierarchy=True, settings=Settings(**SETTINGS))
    assert found.note is None and "vacuum" in found.hits.first()["text"]
    only = search.search(held, {"a": "vacuum", "b": "indexes rows"}, "hybrid", 2)
    assert "keyword results only" in only.note and {r["query_id"] for r in only.hits.collect()} == {"a", "b"}
    assert search.search(held, "indexes", "semantic", 1, embedding.HashingProvider()).hits.count() == 1
    # The settings' limits hold where a call gives none, and many queries are no error.
    assert search.search(held, "rows vacuum indexes", "keyword", settings=Settings(**SETTINGS, keyword_top_k=1)).hits.count() == 1
    assert search.search(held, "rows vacuum indexes", "hybrid", settings=Settings(**SETTINGS, hybrid_top_k=1)).hits.count() == 1
    many = search.search(held, {f"q{k}": "vacuum" for k in range(201)}, "keyword", 1).hits
    assert many.count() == many.select("query_id").distinct().count() == 201
    for bad in (("x", "other", 1), ("", "keyword", 1), ("x", "keyword", 0)):
        with pytest.raises(ValueError):
            search.search(held, *bad)


def test_store_reads_removes_and_backs_up(spark, corpus, tmp_path):
    _, held, _ = indexed(spark, corpus, tmp_path / "store")
    one = held.documents().first()
    assert held.document(one["document_id"]).count() == 1 and held.pages(one["document_id"]).count() == 1
    assert held.chunks(one["document_id"]).count() > 0 and held.hierarchy(one["document_id"]).first()["sequence"] == 0
    chunk = held.chunks(one["document_id"]).first()
    assert held.embedding(chunk["chunk_id"], "hashing", "words", "1", chunk["content_hash"]).count() == 1
    assert held.embedding(chunk["chunk_id"], "hashing", "words", "1", "other").count() == 0
    lookup = held.table("embeddings").where(F.col("chunk_id") == chunk["chunk_id"])
    assert lookup.count() == 1
    plan = lookup._jdf.queryExecution().executedPlan()
    lookup.collect()
    read = plan.collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert read < held.table("embeddings").count()  # files without the chunk aren't read
    assert held.table_names() == sorted(schemas.TABLES) and held.preview("chunks", 1).count() == 1
    for bad in (lambda: held.preview("nothing"), lambda: held.preview("chunks", 0), lambda: held.table("x; drop")):
        with pytest.raises(s.StoreError):
            bad()
    copy = held.prepare_backup(str(tmp_path / "copy"))
    gone = spark.createDataFrame([(one["document_id"],)], "document_id string")
    assert held.remove_documents(gone) == 1 and held.remove_documents(gone) == 0
    assert held.document(one["document_id"]).count() == 0 and held.chunks(one["document_id"]).count() == 0
    assert held.table("embeddings").join(held.table("chunks"), "chunk_id", "left_anti").count() == 0
    held.vacuum()
    assert held.table("documents").count() == 2
    assert s.IndexStore(spark, copy).initialize().table("documents").count() == 3


def test_no_task_writes_a_bucket_whole_and_removals_move_no_text(spark, tmp_path):
    rows = spark.range(0, 80, numPartitions=4).selectExpr("id AS doc_id", "'src' AS source", "'en' AS lang", "repeat(cast(id AS string), 30) AS text")
    held = s.IndexStore(spark, str(tmp_path / "store"), 1).initialize()
    held.replace_documents(*catalog.plain_records(rows))
    for name in ("pages", "hierarchy_nodes", "chunks"):
        assert len(list((tmp_path / "store" / "data" / name).glob("*/_bucket=0/*.parquet"))) >= 4
    assert held.remove_documents(files.table_documents(rows.where("doc_id < 30"))) == 30
    assert sorted(r["chunk_id"] for r in held.table("chunks").collect()) == sorted(f"c{k}" for k in range(30, 80))
    gone = s._sent(files.table_documents(rows).select("document_id"), 80)
    plan = s.without(held.table("pages"), gone, "document_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_tasks_of_an_ingestion_do_not_grow_with_its_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sizing, "TASK_BYTES", 1000)
    rows = [(k, f"Words of document {k}. " * 10, "s") for k in range(40)]
    docs = files.table_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    seen, own = [], ingestion.detect_hierarchy
    monkeypatch.setattr(ingestion, "detect_hierarchy", lambda fresh: seen.append(made := own(fresh)) or seen.append(fresh.rdd.getNumPartitions()) or seen.append(made.rdd.getNumPartitions()) or made)
    before = {name: spark.conf.get(name) for name in (sizing.PARTITIONS, sizing.ADVISORY)}
    summary = ingestion.ingest(docs, s.IndexStore(spark, f"{tmp_path}/store", 8), Settings())
    assert (summary.indexed, summary.status) == (40, "completed")
    parts = -(-sum(len(text) for _, text, _ in rows) // 1000)
    assert seen[1:] == [parts, parts] and parts > int(before[sizing.PARTITIONS])
    assert {name: spark.conf.get(name) for name in before} == before


def test_an_ingestion_leaves_no_shuffles_and_caches_and_moves_a_text_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"Words of document {k}. " * 10, "s") for k in range(40)]
    docs = files.table_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    context, moved = spark.sparkContext._jsc.sc(), []
    write = s.IndexStore._write

    def held():
        found = context.env().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(k).length() for k in range(found.size()) if found.apply(k).getName().endswith(".data")), spark.sparkContext._jsc.getPersistentRDDs().size()

    def seen(self, name, frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        moved.append((name, plan.count("hashpartitioning(document_id")))
        return write(self, name, frame)

    monkeypatch.setattr(s.IndexStore, "_write", seen)
    before, store = held(), s.IndexStore(spark, f"{tmp_path}/store", 8)
    assert ingestion.ingest(docs, store, Settings()).indexed == 40
    after = held()
    assert after[0] - before[0] < 40 * 64 and after[1] == before[1]  # less than the ids of the documents; counts remain
    assert {name: n for name, n in moved if name in ("pages", "hierarchy_nodes", "chunks")} == {"pages": 0, "hierarchy_nodes": 0, "chunks": 0}
    assert not (tmp_path / "store" / "staged").exists()


def test_prepared_rows_meet_bad_documents_and_rows_that_are_held(spark, tmp_path):
    ddl = "doc_id long, text string, source string"
    made = lambda ks, word: files.table_documents(spark.createDataFrame([(k, f"{word} {k}. " * 60, "s") for k in ks], ddl))
    store = s.IndexStore(spark, f"{tmp_path}/store", 3)
    twice = made((5, 6), "Bad").unionByName(made((5,), "Bad"))  # 5 comes twice
    first = ingestion.ingest(made(range(5), "Old").unionByName(twice), store, Settings(chunk_size=100, chunk_overlap=10))
    assert (first.status, first.indexed, set(first.failures)) == ("partial", 6, {("s/5.txt", "a repeated document")})
    second = ingestion.ingest(made(range(3), "New").unionByName(made((7,), "New")), store, Settings(chunk_size=100, chunk_overlap=10))
    assert (second.status, second.indexed, second.failures) == ("completed", 4, ())
    names = {row["document_id"]: int(row["source_filename"].removesuffix(".txt")) for row in store.table("documents").collect()}
    assert sorted(names.values()) == [0, 1, 2, 3, 4, 6, 7]
    word = {3: "Old", 4: "Old", 6: "Bad"}
    for name in ("pages", "hierarchy_nodes", "chunks"):
        texts = {}
        for row in store.table(name).where("text is not null").collect():
            texts.setdefault(names[row["document_id"]], []).append(row["text"])
        assert set(texts) == set(names.values()), name
        assert all(text.split()[0] in (word.get(k, "New"), f"{k}.") for k, found in texts.items() for text in found), name
    # What was prepared and not taken is gone, and each bucket has what one ingestion makes of it.
    alone = s.IndexStore(spark, f"{tmp_path}/alone", 3)
    ingestion.ingest(made((0, 1, 2, 7), "New").unionByName(made((3, 4), "Old")).unionByName(made((6,), "Bad")), alone, Settings(chunk_size=100, chunk_overlap=10))
    for name in ("documents", "pages", "hierarchy_nodes", "chunks"):
        assert sorted(map(str, store.table(name).collect())) == sorted(map(str, alone.table(name).collect())), name
    store.vacuum()
    named = {str(path) for paths in store._manifest()["tables"].values() for path in paths.values()}
    assert all(any(str(file).startswith(f"{tmp_path}/store/{path}/") for path in named) for name in ("hierarchy_nodes", "chunks") for file in (tmp_path / "store/data" / name).rglob("*.parquet"))


def test_nothing_is_written_if_a_rule_is_broken(spark, corpus, tmp_path):
    docs, held, _ = indexed(spark, corpus, tmp_path / "store")
    good = docs.where("status = 'extracted'")
    nodes = hierarchy.detect_hierarchy(good)
    chunks = chunking.chunk_documents(nodes, 60, 10)
    before = held.table("chunks").count()
    for broken in (
        (good, nodes, chunks.withColumn("text", F.concat("text", F.lit("x")))), (good, nodes.where("level <> 'document'"), chunks), (good.unionByName(good), nodes, chunks),
        (good, nodes, chunks.withColumn("page_end", F.lit(5))), (good.limit(1), nodes, chunks), (good, nodes, chunks.withColumn("parent_id", F.lit("none"))),
    ):
        with pytest.raises(s.StoreError):
            held.replace_documents(*broken)
    record = held.table("embeddings").limit(1)
    for bad in (record.withColumn("content_hash", F.lit("other")), record.withColumn("dimension", F.lit(3)), record.unionByName(record), record.withColumn("model_name", F.lit(" "))):
        with pytest.raises(s.StoreError):
            held.save_embeddings(bad)
    with pytest.raises(s.StoreError):
        held.save_index_runs(spark.createDataFrame([("r", "done", 1, 1, 0, datetime(2024, 1, 1), None, None)], schemas.INDEX_RUN))
    assert held.table("chunks").count() == before


def test_migration(spark):
    old = spark.createDataFrame([("c", "m", "1", 2, [1.0, 2.0], "2024-01-01T00:00:00")], "chunk_id string, model_name string, model_version string, dimension int, vector array<double>, created_at string")
    row = s.migrate_embeddings(old).first()
    assert (row["provider_name"], row["content_hash"], row["created_at"]) == ("legacy", "", datetime(2024, 1, 1))


def test_evaluation(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([{"case_id": " a ", "query": "q", "relevant_chunk_ids": ["x", " x ", "y"]}, {"case_id": "b", "query": "r", "relevant_document_ids": ["d"]}]), encoding="utf-8")

    def retrieve(session, queries):
        assert queries == {"a": "q", "b": "r"}
        return session.createDataFrame([("a", "x", "d", 1), ("b", "z", "d", 2), ("b", "w", "e", 1)], "query_id string, chunk_id string, document_id string, rank int")

    run = evaluate.run_evaluation(spark, str(path), retrieve, output=str(tmp_path / "out" / "run.json"))
    assert json.loads((tmp_path / "out" / "run.json").read_text())["averages"] == run["averages"]
    assert run["averages"]["mrr"] == 0.75 and [c["recall_at_5"] for c in run["cases"]] == [0.5, 1.0]
    for bad in ("[]", '[{"case_id": "a", "query": "q"}]', '[{"case_id": "", "query": "q", "relevant_chunk_ids": ["x"]}]', '[{"case_id": "a", "query": "q", "relevant_chunk_ids": ["x"]}, {"case_id": "a", "query": "q", "relevant_chunk_ids": ["x"]}]', "{not json"):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(files.CorpusError):
            files.read_evaluation_cases(spark, str(path))
    lines = tmp_path / "cases.jsonl"
    lines.write_text('{"case_id": "a", "query": "q", "relevant_chunk_ids": ["x"]}\n{"case_id": "b", "query": "q", "relevant_chunk_ids": ["x"]}\n', encoding="utf-8")
    assert files.read_evaluation_cases(spark, str(lines)).count() == 2
    assert evaluate.load_retriever("json:loads") is json.loads
    with pytest.raises(ValueError):
        evaluate.load_retriever("json")


def test_a_stream_of_documents_equals_a_batch(spark, corpus, tmp_path):
    docs = files.read_corpus(spark, str(corpus), lambda _: None)
    docs.where("status <> 'unreadable'").repartition(3).write.parquet(str(tmp_path / "landing"))
    held = s.IndexStore(spark, str(tmp_path / "streamed"), 4)
    for _ in range(2):  # a second run has nothing to do
        incremental.start_ingestion(incremental.document_stream(spark, str(tmp_path / "landing"), 1), held, Settings(**SETTINGS), str(tmp_path / "check"), once=True).awaitTermination()
    batch = s.IndexStore(spark, str(tmp_path / "batch"), 4)
    ingestion.ingest(docs, batch, Settings(**SETTINGS))
    ids = lambda store: sorted(r[0] for r in store.table("chunks").select("chunk_id").collect())
    assert ids(held) == ids(batch)


def test_small_files_share_tasks_and_are_listed_once(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.txt").write_text(f"text {k}")
    (tmp_path / "x.PDF").write_bytes(b"none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a part for each file
    try:
        assert spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions() > 150
        docs = files.read_corpus(spark, str(tmp_path), lambda _: None)
        assert docs.rdd.getNumPartitions() <= 300 // files.SCAN_PARTS + 1 + 4 * spark.sparkContext.defaultParallelism
        assert docs.count() == 301 and docs.where("status = 'unreadable'").select("source_path").collect()[0][0] == "x.PDF"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
