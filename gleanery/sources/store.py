"""The index store: parquet tables under one folder, versioned by a manifest.

Tables are split in buckets by document. A write makes new files for the buckets
it touches, next to the old ones, and then one new manifest; readers see a whole
write or nothing of it, and a failed one leaves the last manifest in force. There
is one writer at a time. ``vacuum`` deletes what no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import text as t
from gleanery.operators.chunking import check_pages
from gleanery.operators.embedding import invalid_records

#: Ids of documents, at most, that are sent to every task; more are joined by a shuffle.
FEW_IDS = 1_000_000
#: Where prepared rows go that have an error; no document has this bucket.
ERRORS = -1
FAILED_STATUSES = ("unreadable", "failed", "encrypted")
OF_DOCUMENT = ("documents", "pages", "hierarchy_nodes", "chunks", "embeddings")
FAILURE = "source_path string, reason string, chunk_id string"
RUN_STATUSES = ("completed", "partial", "failed", "empty")


class StoreError(ValueError):
    """Records break the store's rules; nothing was written."""


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifest and files.

    def initialize(self) -> IndexStore:
        """Creates the store if there is none; else leaves it as it is."""
        if not self._versions():
            self._write_manifest({"buckets": self.buckets, "tables": {name: {} for name in schemas.TABLES}}, 1)
        self.buckets = self._manifest()["buckets"]
        return self

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def _manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            raise StoreError("the store isn't initialized")
        stream = self._files.open(self._path(f"{self.root}/manifest/{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_manifest(self, manifest: dict, version: int) -> None:
        staged = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(staged)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not self._files.rename(staged, self._path(f"{self.root}/manifest/{version:012d}.json")):
            raise StoreError("another writer has changed the store")

    def _bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets, with column bucket."""
        held = self._manifest()["tables"][name]
        return self._rows(name, [path for bucket, path in held.items() if buckets is None or int(bucket) in buckets])

    def _rows(self, name: str, paths: list[str], more: str = "") -> DataFrame:
        schema = schemas.struct(schemas.TABLES[name] + ", bucket int" + more)
        if not paths:
            return self.spark.createDataFrame([], schema).limit(0)  # known to be empty: what is joined with it needn't move
        return self.spark.read.schema(schema).parquet(*sorted(f"{self.root}/{path}" for path in paths))

    def table(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise StoreError(f"no such table: {name}")
        return self._read(name).drop("bucket")

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows (with column bucket) to a new folder of a table; its paths by bucket."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        columns = [field.name for field in schemas.struct(schemas.TABLES[name])]
        kept = rows.select(*columns, "bucket", *(["error"] if "error" in rows.columns else [])).withColumn("_bucket", F.col("bucket"))
        # Each task writes its rows of all buckets: nothing moves, and no task has a bucket whole.
        writer = kept.write.option("compression", "zstd").partitionBy("_bucket")
        if "chunk_id" in columns:  # looked up by itself: a reader skips what can't have it
            writer = writer.option("parquet.bloom.filter.enabled#chunk_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.root}/{folder}")
        parts = [status.getPath().getName() for status in self._files.listStatus(self._path(f"{self.root}/{folder}"))]
        return {part.removeprefix("_bucket="): f"{folder}/{part}" for part in parts if part.startswith("_bucket=")}

    def _commit(self, changed: dict[str, DataFrame], buckets: list[int], taken: dict[str, dict[str, str]] | None = None) -> None:
        """Puts new rows (with column bucket), and what is written already (``taken``), in place of whole buckets."""
        manifest, taken = self._manifest(), taken or {}
        for name in changed | taken:
            held = {bucket: path for bucket, path in manifest["tables"][name].items() if int(bucket) not in buckets}
            manifest["tables"][name] = held | taken.get(name, {}) | (self._write(name, changed[name]) if name in changed else {})
        self._write_manifest(manifest, self._versions()[-1] + 1)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes files that none of the last ``keep`` manifests names, and older manifests."""
        versions = self._versions()
        current = json.dumps(self._manifest()) if keep == 1 else "".join(self._text(v) for v in versions[-keep:])
        for name in schemas.TABLES:
            folder = self._path(f"{self.root}/data/{name}")
            if self._files.exists(folder):
                for status in self._files.listStatus(folder):
                    if status.getPath().getName() not in current:
                        self._files.delete(status.getPath(), True)
        for version in versions[:-keep]:
            self._files.delete(self._path(f"{self.root}/manifest/{version:012d}.json"), False)

    def _text(self, version: int) -> str:
        stream = self._files.open(self._path(f"{self.root}/manifest/{version:012d}.json"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def prepare_backup(self, target: str) -> str:
        """Copies the current version, whole, to a folder that doesn't exist yet."""
        to, conf = self._path(target), self.spark._jsc.hadoopConfiguration()
        other = to.getFileSystem(conf)
        if other.exists(to):
            raise StoreError("the target exists")
        for path in {path for held in self._manifest()["tables"].values() for path in held.values()}:
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._files, self._path(f"{self.root}/{path}"), other, self._path(f"{target}/{path}"), False, conf)
        last = self._versions()[-1]
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._files, self._path(f"{self.root}/manifest/{last:012d}.json"), other, self._path(f"{target}/manifest/{last:012d}.json"), False, conf)
        return target

    # Writes.

    def _touched(self, ids: DataFrame) -> tuple[list[int], int]:
        """Buckets of documents, at most as many as the store has, and the number of rows."""
        rows = ids.groupBy(self._bucket(F.col("document_id")).alias("b")).count().collect()
        return [row["b"] for row in rows], sum(row["count"] for row in rows)

    def replace_documents(self, documents: DataFrame, nodes: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None, warnings: DataFrame | None = None) -> None:
        """Puts documents with all that derives from them in place of what the store has of them.

        Embeddings of chunks that stay the same stay. Nothing is written if a rule is broken.
        """
        records = self._no_records() if embeddings is None else embeddings
        problem = integrity_problems(documents, nodes, chunks, records).first()
        if problem:
            raise StoreError(f"{problem['problem']}: {problem['key']}")
        self._replace(documents, nodes, chunks, records, warnings)

    def _no_records(self) -> DataFrame:
        return self.spark.createDataFrame([], schemas.struct(schemas.EMBEDDING)).limit(0)

    def prepare(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows of documents to where they are to stay, for ``replace_prepared``; rows with an error go to bucket ERRORS."""
        bucket = self._bucket(F.col("document_id"))
        if "error" in rows.columns:
            bucket = F.when(F.col("error").isNull(), bucket).otherwise(ERRORS)
        return self._write(name, rows.withColumn("bucket", bucket))

    def prepared(self, name: str, paths: dict[str, str]) -> DataFrame:
        """The rows that ``prepare`` has written."""
        return self._rows(name, [path for bucket, path in paths.items() if int(bucket) != ERRORS]).drop("bucket")

    def prepared_errors(self, name: str, paths: dict[str, str]) -> DataFrame:
        """The rows that ``prepare`` has written for their errors: document_id, error."""
        return self._rows(name, [path for bucket, path in paths.items() if int(bucket) == ERRORS], ", error string").select("document_id", "error")

    def replace_prepared(self, documents: DataFrame, ready: dict[str, dict[str, str]], bad: DataFrame, warnings: DataFrame) -> None:
        """As ``replace_documents``, for checked documents whose nodes and chunks are prepared; those of ``bad`` documents stay out.

        A prepared bucket is taken as it is, unless the store holds rows of the bucket or it has a bad document's: those are written anew.
        """
        spoilt = {row["b"] for row in bad.select(self._bucket(F.col("document_id")).alias("b")).distinct().collect()}
        whole = [without(self.prepared(name, ready[name]), bad, "document_id") for name in ("hierarchy_nodes", "chunks")]
        self._replace(documents, *whole, self._no_records(), warnings, ready, spoilt, bad)

    def discard(self, ready: dict[str, dict[str, str]]) -> None:
        """Deletes what was prepared and not taken."""
        tables = self._manifest()["tables"]
        for name, paths in ready.items():
            for path in set(paths.values()) - set(tables[name].values()):
                self._files.delete(self._path(f"{self.root}/{path}"), True)

    def _replace(self, documents: DataFrame, nodes: DataFrame, chunks: DataFrame, records: DataFrame, warnings: DataFrame | None, ready: dict[str, dict[str, str]] | None = None, spoilt: set[int] = frozenset(), bad: DataFrame | None = None) -> None:
        ids = documents.select("document_id").distinct()
        buckets, count = self._touched(ids)
        gone = _sent(ids, count)
        bucket = self._bucket(F.col("document_id")).alias("bucket")
        if warnings is None:
            warnings = documents.select("document_id", F.col("warnings").alias("hierarchy_warnings"))
        digest = F.col("digest") if "digest" in documents.columns else F.lit(None).cast("string")
        new = {
            "documents": documents.withColumn("digest", digest).drop("pages", "outlines").join(warnings, "document_id"),
            "pages": documents.select("document_id", F.inline("pages")),
            "hierarchy_nodes": nodes,
            "chunks": chunks,
        }
        tables, taken, changed = self._manifest()["tables"], {}, {}
        for name, rows in new.items():
            if name not in (ready or {}):
                changed[name] = replace_rows(self._read(name, buckets), gone, rows.withColumn("bucket", bucket), "document_id")
                continue
            anew = [b for b in buckets if b in spoilt or str(b) in tables[name]]
            taken[name] = {b: path for b, path in ready[name].items() if int(b) in buckets and int(b) not in anew}
            if anew:
                rows = without(self._rows(name, [ready[name][str(b)] for b in anew if str(b) in ready[name]]), bad, "document_id")
                changed[name] = replace_rows(self._read(name, anew), gone, rows, "document_id")
        owners = chunks.select("chunk_id", "content_hash", bucket)
        held = self._read("embeddings", buckets)
        old_chunks = self._read("chunks", buckets).join(ids, "document_id").select("chunk_id")
        stay = held.join(old_chunks, "chunk_id", "left_anti").unionByName(held.join(owners.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi"))
        fresh = records.join(owners, ["chunk_id", "content_hash"])
        key = ["chunk_id", "provider_name", "model_name", "model_version"]
        changed["embeddings"] = upsert(stay, fresh, key)
        self._commit(changed, buckets, taken)

    def remove_documents(self, ids: DataFrame) -> int:
        """Removes documents (document_id) and all that derives from them; tells how many there were."""
        ids = ids.select("document_id").distinct()
        known = self.table("documents").join(ids, "document_id", "left_semi").select("document_id")
        count = known.count()
        if count:
            buckets, _ = self._touched(known)
            ids = _sent(known, count)
            gone = self._read("chunks", buckets).join(ids, "document_id", "left_semi").select("chunk_id")
            changed = {name: without(self._read(name, buckets), ids, "document_id") for name in OF_DOCUMENT if name != "embeddings"}
            changed["embeddings"] = without(self._read("embeddings", buckets), gone, "chunk_id")
            self._commit(changed, buckets)
        return count

    def save_embeddings(self, records: DataFrame) -> None:
        """Adds records, or replaces those of the same chunk and model; all must fit the stored chunks."""
        key = ["chunk_id", "provider_name", "model_name", "model_version"]
        owners = self.table("chunks").select("chunk_id", "content_hash", "document_id")
        problems = (
            _problem(invalid_records(records), "an invalid embedding", "chunk_id")
            .unionByName(_problem(records.groupBy(*key).count().where("count > 1"), "a repeated embedding", "chunk_id"))
            .unionByName(_problem(records.join(owners, ["chunk_id", "content_hash"], "left_anti"), "an embedding of an unknown chunk or other text", "chunk_id"))
        )
        problem = problems.first()
        if problem:
            raise StoreError(f"{problem['problem']}: {problem['key']}")
        placed = records.join(owners, ["chunk_id", "content_hash"])
        buckets, _ = self._touched(placed)
        held = self._read("embeddings", buckets)
        fresh = placed.withColumn("bucket", self._bucket(F.col("document_id"))).select(*held.columns)
        self._commit({"embeddings": upsert(held, fresh, key)}, buckets)

    def save_index_runs(self, runs: DataFrame) -> None:
        """Adds runs, or replaces those of the same id."""
        bad = runs.where(~F.col("status").isin(*RUN_STATUSES) | (t.trim(F.coalesce("run_id", F.lit(""))) == "") | (F.least("document_count", "chunk_count", "failure_count") < 0))
        if not bad.isEmpty():
            raise StoreError("an invalid index run")
        held = self._read("index_runs")
        self._commit({"index_runs": upsert(held, runs.withColumn("bucket", F.lit(0)), ["run_id"])}, [0])

    def save_failures(self, run_id: str, failures: DataFrame) -> int:
        """Writes a run's failures (source_path, reason, chunk_id) beside the tables, however many; tells how many there are."""
        path = f"{self.root}/failures/{run_id}"
        failures.write.parquet(path)
        return self.failures(run_id).count()

    def failures(self, run_id: str) -> DataFrame:
        return self.spark.read.schema(FAILURE).parquet(f"{self.root}/failures/{run_id}")

    def staged(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Rows written to the store's own folder for the time of a run; ``clear_staged`` deletes them, or those of a name."""
        path = f"{self.root}/staged/{name or uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear_staged(self, name: str | None = None) -> None:
        self._files.delete(self._path(f"{self.root}/staged/{name}" if name else f"{self.root}/staged"), True)

    # Scans.

    def document(self, document_id: str) -> DataFrame:
        return self._of_document("documents", document_id).limit(1)

    def documents(self) -> DataFrame:
        return in_order(self.table("documents"))

    def pages(self, document_id: str) -> DataFrame:
        return self._of_document("pages", document_id).orderBy("page_number")

    def hierarchy(self, document_id: str) -> DataFrame:
        return self._of_document("hierarchy_nodes", document_id).orderBy("sequence", "node_id")

    def chunks(self, document_id: str) -> DataFrame:
        return self._of_document("chunks", document_id).orderBy("sequence", "chunk_id")

    def _of_document(self, name: str, document_id: str) -> DataFrame:
        """A document's rows, from its bucket alone."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(document_id))).first()[0]
        return self._read(name, [bucket]).drop("bucket").where(F.col("document_id") == document_id)

    def embedding(self, chunk_id: str, provider_name: str, model_name: str, model_version: str, content_hash: str | None = None) -> DataFrame:
        keys = {"chunk_id": chunk_id, "provider_name": provider_name, "model_name": model_name, "model_version": model_version} | ({} if content_hash is None else {"content_hash": content_hash})
        rows = self.table("embeddings")
        for name, value in keys.items():
            rows = rows.where(F.col(name) == value)
        return rows.limit(1)

    def index_run(self, run_id: str) -> DataFrame:
        return self.table("index_runs").where(F.col("run_id") == run_id).limit(1)

    def table_names(self) -> list[str]:
        return sorted(self._manifest()["tables"])

    def preview(self, name: str, limit: int = 100) -> DataFrame:
        return previewed(self.table(name), limit)

    def statistics(self) -> DataFrame:
        return index_statistics(self.table("documents"), self.table("chunks"))


def in_order(documents: DataFrame) -> DataFrame:
    """All documents by path without regard to case, then by id."""
    return documents.orderBy(t.fold(F.col("source_path")), "document_id")


def previewed(rows: DataFrame, limit: int) -> DataFrame:
    """Some rows of a table."""
    if limit <= 0:
        raise StoreError("the limit must be above zero")
    return rows.limit(limit)


def index_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks and failures."""
    left = documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status").isin(*FAILED_STATUSES)).alias("failures"))
    return left.join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))), F.lit(True)).select("documents", "chunks", "failures")


def _problem(rows: DataFrame, what: str, key: str) -> DataFrame:
    return rows.select(F.lit(what).alias("problem"), F.col(key).alias("key"))


def _of_document(rows: DataFrame, what: str, key: str) -> DataFrame:
    return rows.select(F.lit(what).alias("problem"), "document_id")


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """The keys that several rows have."""
    return rows.groupBy(key).count().where("count > 1")


def _repeating(rows: DataFrame, key: str) -> DataFrame:
    """The rows of such keys; keys move only if two have the same hash."""
    hashed = rows.select("document_id", F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"))
    shared = hashed.groupBy("_hash").count().where("count > 1").select("_hash")
    if shared.isEmpty():
        return rows.select("document_id").limit(0)
    return hashed.join(shared, "_hash", "left_semi").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key"))).where("_n > 1")


def integrity_problems(documents: DataFrame, nodes: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What breaks the store's rules, as (problem, key): repeated ids, missing parents, pages or owners, other texts."""
    found = _record_problems(documents, nodes, chunks, _problem, _repeated, lambda rows, *_: rows) + [
        _problem(invalid_records(embeddings), "an invalid embedding", "chunk_id"),
        _problem(embeddings.join(chunks, ["chunk_id", "content_hash"], "left_anti"), "an embedding of an unknown chunk or other text", "chunk_id"),
    ]
    return reduce(DataFrame.unionByName, found)


def _record_problems(documents: DataFrame, nodes: DataFrame, chunks: DataFrame, problem: Callable, repeated: Callable, few: Callable) -> list[DataFrame]:
    """Each rule's problems: the rows that break it, by ``problem(rows, what, key)``; ``few(rows, *columns)`` may take equal rows once."""
    again = lambda rows, key, what: problem(repeated(rows, key), what, key)
    ids = documents.select("document_id")
    parents = nodes.select(F.col("node_id").alias("parent_id"), "document_id")
    pages = documents.select("document_id", F.col("pages.page_number").alias("_pages"))
    return [
        again(documents, "document_id", "a repeated document"),
        again(documents, "source_path", "a repeated source path"),
        again(nodes, "node_id", "a repeated node"),
        again(chunks, "chunk_id", "a repeated chunk"),
        problem(few(nodes, "document_id").join(ids, "document_id", "left_anti"), "a node of an unknown document", "node_id"),
        problem(few(chunks, "document_id").join(ids, "document_id", "left_anti"), "a chunk of an unknown document", "chunk_id"),
        problem(few(nodes.where("parent_id is not null"), "document_id", "parent_id").join(parents, ["parent_id", "document_id"], "left_anti"), "a node without its parent", "node_id"),
        problem(nodes.where("parent_id is not null").join(nodes.select(F.col("node_id").alias("parent_id"), F.col("sequence").alias("_above")), "parent_id").where("_above >= sequence"), "a node before its parent", "node_id"),
        problem(few(chunks, "document_id", "parent_id").join(parents, ["parent_id", "document_id"], "left_anti"), "a chunk without its node", "chunk_id"),
        problem(check_pages(nodes, documents), "a node of a missing page", "node_id"),
        problem(few(chunks, "document_id", "page_start", "page_end").join(pages, "document_id").where((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")) | ~F.array_contains("_pages", F.col("page_start")) | ~F.array_contains("_pages", F.col("page_end"))), "a chunk of a missing page", "chunk_id"),
        problem(chunks.where(F.sha2("text", 256) != F.col("content_hash")), "a chunk with another text's hash", "chunk_id"),
    ]


def _sent(ids: DataFrame, count: int) -> DataFrame:
    """``ids``, sent to every task if they are few, so that the texts they are compared with stay where they are."""
    return F.broadcast(ids) if count <= FEW_IDS else ids


def without(held: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``held`` without the rows whose key ``gone`` has."""
    return held.join(gone.select(key), key, "left_anti")


def broken_documents(documents: DataFrame, nodes: DataFrame, chunks: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """document_id and problem of each document of which a record breaks a rule.

    ``keep`` writes what a rule finds, one after the other, so that what one moves is gone before the next.
    """
    found = [keep(rows.distinct()) for rows in _record_problems(documents, nodes, chunks, _of_document, _repeating, lambda rows, *columns: rows.select(*columns).distinct())]
    return reduce(DataFrame.unionByName, found).groupBy("document_id").agg(F.min("problem").alias("problem"))


def replace_rows(held: DataFrame, gone: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``held`` with ``fresh`` rows in place of all rows whose key ``gone`` has."""
    return without(held, gone, key).unionByName(fresh, allowMissingColumns=True)


def upsert(held: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """``held`` with the rows of ``fresh`` in place of those of equal keys."""
    return held.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*held.columns))


def migrate_embeddings(old: DataFrame) -> DataFrame:
    """Records from before providers and hashes were kept; their empty hash equals no text's."""
    with_columns = {"provider_name": F.lit("legacy"), "content_hash": F.lit("")}
    added = old.withColumns({name: value for name, value in with_columns.items() if name not in old.columns})
    return added.select(*(F.col(field.name).cast(field.dataType) for field in schemas.struct(schemas.EMBEDDING)))
