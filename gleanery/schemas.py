"""Schemas of all records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = "struct<page_number:int,text:string,warnings:array<string>>"
OUTLINE = "struct<title:string,page_number:int,level:int,order:int>"
DOCUMENT = (
    "document_id string, source_filename string, source_path string, content_sha256 string, page_count int, "
    f"metadata map<string,string>, pages array<{PAGE}>, status string, warnings array<string>, outlines array<{OUTLINE}>"
)
STORED_DOCUMENT = "document_id string, source_filename string, source_path string, content_sha256 string, page_count int, metadata map<string,string>, status string, warnings array<string>, hierarchy_warnings array<string>, digest string"
STORED_PAGE = "document_id string, page_number int, text string, warnings array<string>"
NODE = (
    "node_id string, document_id string, parent_id string, level string, section_title string, section_path array<string>, "
    "page_start int, page_end int, sequence int, detection_method string, confidence double, text string"
)
CHUNK = (
    "chunk_id string, document_id string, parent_id string, level string, section_title string, section_path array<string>, "
    "previous_chunk_id string, next_chunk_id string, page_start int, page_end int, sequence int, text string, chunk_size int, "
    "size_unit string, token_count int, content_hash string, configuration_fingerprint string, chunker_version string"
)
EMBEDDING = "chunk_id string, provider_name string, model_name string, model_version string, content_hash string, dimension int, vector array<double>, created_at timestamp"
INDEX_RUN = "run_id string, status string, document_count int, chunk_count int, failure_count int, started_at timestamp, finished_at timestamp, safe_error_summary string"
EVALUATION_CASE = "case_id string, query string, relevant_chunk_ids array<string>, relevant_document_ids array<string>"
METADATA_KEYS = ("title", "author", "subject", "creator", "producer", "creation_date", "modification_date")
STATUSES = ("extracted", "empty", "partial", "unreadable", "encrypted")
LEVELS = ("document", "chapter", "section", "subsection", "page", "content")
TABLES = {"documents": STORED_DOCUMENT, "pages": STORED_PAGE, "hierarchy_nodes": NODE, "chunks": CHUNK, "embeddings": EMBEDDING, "index_runs": INDEX_RUN}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
