"""Corpus files and evaluation sets as DataFrames.

Files are listed and read by Spark, so a corpus can lie in any store that Spark
reads. What fails, fails for its document alone and is told by status and warnings.
"""

from __future__ import annotations

import hashlib
import io
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import schemas
from gleanery.functions import text as t
from gleanery.shipping import ship_package

#: Characters below which a page has little text.
LITTLE = 20
#: Parts of a scan that a task reads, one after the other, where there are many.
SCAN_PARTS = 32


class CorpusError(ValueError):
    """A corpus or data set can't be read as one."""


def corpus_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "txt")) -> DataFrame:
    """Files under ``root`` with their path, relative path, name, length and content, in no order.

    Other suffixes are left out when files are listed, and content that isn't selected
    isn't read. Where the file system has links, a file whose real path is outside the root's is left out.
    """
    return _located(spark, root, _listed(spark, root, suffixes))


def _listed(spark: SparkSession, root: str, suffixes: tuple[str, ...]) -> DataFrame:
    either = ",".join("".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else x for x in suffix) for suffix in suffixes)
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{either}}}").load(root)
    except AnalysisException as error:
        raise CorpusError(f"no corpus folder: {root}") from error


def _located(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Listed files, read in tasks of a fitting size, with their paths below ``root``."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = system.makeQualified(base)
    if not system.getFileStatus(whole).isDirectory():
        raise CorpusError(f"not a folder: {root}")
    prefix = whole.toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9+.\-]+:(//[^/]*)?(?=/)", "")
    relative = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    # A scan takes each file for one of 4 MB, so that small ones make tasks of a few files, which take longer to start than to read.
    parts = files.rdd.getNumPartitions()
    files = files.coalesce(max(1, min(parts, 4 * spark.sparkContext.defaultParallelism), parts // SCAN_PARTS))
    if whole.toUri().getScheme() == "file":
        ship_package(spark)
        files = files.where(lies_within(prefix)(path))
    return files.select("path", relative.alias("source_path"), F.element_at(F.split(relative, "/"), -1).alias("source_filename"), "length", "content")


def lies_within(root: str):
    """A function of columns of local paths: whether they lie below ``root`` once links are resolved."""

    @F.pandas_udf(T.BooleanType())
    def within(paths):
        real = os.path.realpath(root).rstrip("/") + "/"
        return paths.map(lambda path: os.path.realpath(path).startswith(real))

    return within


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("pdf", "txt")) -> DataFrame:
    """The listing of a corpus, without contents: path, relative path, name and length, by case-folded path."""
    return corpus_files(spark, root, suffixes).drop("content").orderBy(t.fold(F.col("source_path")), "source_path")


def no_metadata() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, schemas.METADATA_KEYS)), F.array(*(F.lit(None).cast("string") for _ in schemas.METADATA_KEYS)))


def text_documents(files: DataFrame) -> DataFrame:
    """Text files (source_path, source_filename, content) as documents of one page.

    Bytes that aren't UTF-8 make a document unreadable: validity is a built-in
    check, so decoding stays in the JVM.
    """
    raw = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    return documents_of_text(files.withColumn("_valid", F.is_valid_utf8(raw.cast("string"))).withColumn("_text", F.when(F.col("_valid"), F.regexp_replace(raw.cast("string"), r"\r\n?", "\n"))), F.col("_text"), F.sha2("content", 256))


def documents_of_text(rows: DataFrame, text: Column, digest: Column) -> DataFrame:
    """Documents from rows with source_path, source_filename and a text; a null text is unreadable."""
    size = F.length(t.trim(text))
    known = text.isNotNull()
    none = F.array().cast("array<string>")
    status = F.when(~known, "unreadable").when(size == 0, "empty").when(size < LITTLE, "partial").otherwise("extracted")
    warnings = F.when(~known, F.array(F.lit("text_read_failed"))).when(size == 0, F.array(F.lit("text_file_empty"))).when(size < LITTLE, F.array(F.lit("text_file_little_text"))).otherwise(none)
    of_page = F.when(size == 0, F.array(F.lit("no_extractable_text"))).when(size < LITTLE, F.array(F.lit("little_extractable_text"))).otherwise(none)
    page = F.struct(F.lit(1).alias("page_number"), text.alias("text"), of_page.alias("warnings"))
    return rows.select(
        F.sha2("source_path", 256).alias("document_id"), "source_filename", "source_path", F.when(known, digest).alias("content_sha256"),
        F.when(known, 1).otherwise(0).alias("page_count"), no_metadata().alias("metadata"),
        F.when(known, F.array(page)).otherwise(F.array().cast(f"array<{schemas.PAGE}>")).alias("pages"), status.alias("status"), warnings.alias("warnings"),
        F.array().cast(f"array<{schemas.OUTLINE}>").alias("outlines"),
    )


def pdf_documents(files: DataFrame, reader=None) -> DataFrame:
    """PDF files as documents; ``reader(bytes)`` opens one and defaults to pypdf's, which must then be installed.

    A page that can't be read is empty and warned of; a file that can't be parsed
    keeps the pages read so far.
    """
    spark = files.sparkSession
    ship_package(spark)
    schema = schemas.struct(schemas.DOCUMENT)
    names = schema.names

    def run(batches):
        import pandas as pd

        opened = reader or _pypdf
        for batch in batches:
            rows = [_read_pdf(*values, opened) for values in zip(batch["source_path"], batch["source_filename"], batch["content"])]
            yield pd.DataFrame(rows, columns=names)

    return files.select("source_path", "source_filename", "content").mapInPandas(run, schema)


def _pypdf(content: bytes):
    from pypdf import PdfReader

    return PdfReader(io.BytesIO(content), strict=False)


def _read_pdf(path: str, name: str, content: bytes, opened) -> dict:
    found = {
        "document_id": hashlib.sha256(path.encode()).hexdigest(), "source_filename": name, "source_path": path, "content_sha256": hashlib.sha256(content).hexdigest(),
        "page_count": 0, "metadata": dict.fromkeys(schemas.METADATA_KEYS), "pages": [], "status": "unreadable", "warnings": [], "outlines": [],
    }
    pages, warnings = found["pages"], found["warnings"]
    try:
        pdf = opened(content)
        count = len(pdf.pages)
        found["metadata"] = _metadata(pdf.metadata)
        found["outlines"] = list(_outlines(pdf, warnings))
        if pdf.is_encrypted:
            return found | {"page_count": count, "status": "encrypted", "warnings": ["encrypted_pdf"]}
        for number, page in enumerate(pdf.pages, 1):
            notes = []
            try:
                text = page.extract_text() or ""
            except Exception:  # noqa: BLE001  any failure of a page is that page's alone
                text = ""
                notes.append("page_text_extraction_failed")
            size = len(text.strip())
            if size < LITTLE:
                notes.append("little_extractable_text" if size else "no_extractable_text")
            warnings.extend(f"page_{number}_{note.removeprefix('page_')}" for note in notes)
            pages.append({"page_number": number, "text": text, "warnings": notes})
    except Exception:  # noqa: BLE001
        warnings.append("pdf_parse_failed")
        return found | {"page_count": len(pages), "metadata": dict.fromkeys(schemas.METADATA_KEYS)}
    written = any(page["text"].strip() for page in pages)
    return found | {"page_count": count, "status": "empty" if not written else "partial" if warnings else "extracted"}


def _metadata(raw) -> dict:
    """The seven known entries of a PDF's metadata; absent ones are null."""
    named = {"creation_date": "/CreationDate", "modification_date": "/ModDate"}
    values = {key: (raw or {}).get(named.get(key, f"/{key.capitalize()}")) for key in schemas.METADATA_KEYS}
    return {key: None if value is None else str(value) for key, value in values.items()}


def _outlines(pdf, warnings: list):
    """Outline entries depth first, with their nesting level; what can't be resolved is warned of."""
    try:
        pending = [(0, entry) for entry in reversed(pdf.outline)]
    except Exception:  # noqa: BLE001
        warnings.append("outline_read_failed")
        return
    order = 0
    while pending:
        level, entry = pending.pop()
        if isinstance(entry, list):
            pending.extend((level + 1, nested) for nested in reversed(entry))
            continue
        title = str(getattr(entry, "title", "") or "").strip()
        try:
            page = pdf.get_destination_page_number(entry) + 1
        except Exception:  # noqa: BLE001
            page = 0
        if not title or page < 1:
            warnings.append("outline_item_missing_title" if not title else "outline_item_page_unavailable")
            continue
        yield {"title": title, "page_number": page, "level": level, "order": order}
        order += 1


def read_corpus(spark: SparkSession, root: str, pdf_reader=None) -> DataFrame:
    """All documents of a corpus folder, which is listed once; a file of another kind isn't opened, as names are told before."""
    listed = _listed(spark, root, ("pdf", "txt"))
    of = lambda suffix: _located(spark, root, listed.where(F.lower(F.col("_metadata.file_name")).endswith(suffix)))
    return text_documents(of(".txt")).unionByName(pdf_documents(of(".pdf"), pdf_reader))


def table_documents(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, source, text) as documents named by source and id."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs.select(F.concat_ws("/", "source", name).alias("source_path"), name.alias("source_filename"), F.coalesce("text", F.lit("")).alias("_text"))
    return documents_of_text(rows, F.col("_text"), F.sha2("_text", 256))


def read_evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array or, by suffix, JSON lines; validated as a whole."""
    reader = spark.read.schema(schemas.EVALUATION_CASE + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    raw = reader.json(path, multiLine=not path.lower().endswith(".jsonl"))
    clean = lambda ids: F.array_distinct(F.filter(F.transform(F.coalesce(ids, F.array().cast("array<string>")), t.trim), lambda x: x != ""))
    cases = raw.select(t.trim(F.col("case_id")).alias("case_id"), t.trim(F.col("query")).alias("query"), clean(F.col("relevant_chunk_ids")).alias("relevant_chunk_ids"), clean(F.col("relevant_document_ids")).alias("relevant_document_ids"), "_corrupt_record")
    problems = cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("invalid JSON"),
        F.count_if(F.coalesce(F.col("case_id"), F.lit("")) == "").alias("a case without case_id"),
        F.count_if(F.coalesce(F.col("query"), F.lit("")) == "").alias("a case without query"),
        F.count_if((F.size("relevant_chunk_ids") == 0) & (F.size("relevant_document_ids") == 0)).alias("a case without relevant ids"),
        (F.count("case_id") - F.count_distinct("case_id")).alias("equal case ids"),
    ).first()
    if not problems["n"]:
        raise CorpusError("the data set has no cases")
    for name, count in problems.asDict().items():
        if name != "n" and count:
            raise CorpusError(f"the data set has {name}")
    return cases.drop("_corrupt_record")
