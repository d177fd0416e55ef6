"""Chunks of documents: section groups, text atoms, greedy packing with overlap, links.

Packing with overlap backtracks, depending on the data, so ``chunk_documents`` runs
in Arrow batches with one row a document; its nodes are all it needs at a time. A
document that can't be chunked fails alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.functions import text as t
from gleanery.shipping import ship_package

CHUNKER_VERSION = "1"
DEFAULT_TOKENIZER = "lexical-token-estimate"
TOKENS = re.compile(r"\w+|[^\w\s]")
#: Text, in characters, after which chunks are handed on.
BATCH_CHARACTERS = 1_000_000
#: What the chunker reads of a node.
CHUNKED = ("node_id", "parent_id", "level", "section_title", "section_path", "page_start", "sequence", "text")
SENTENCES = re.compile(r"(?<=[.!?;:])\s+")


class ChunkingError(ValueError):
    """Content can't be chunked as asked."""


def check_sizes(size: int, overlap: int, unit: str) -> None:
    if size <= 0:
        raise ChunkingError("the chunk size must be above zero")
    if not 0 <= overlap < size:
        raise ChunkingError("the overlap must be from zero to below the chunk size")
    if unit not in ("characters", "tokens"):
        raise ChunkingError("the unit must be characters or tokens")


def tokenizer_name(tokenizer: Callable[[str], int] | None) -> str:
    if tokenizer is None:
        return DEFAULT_TOKENIZER
    return f"{tokenizer.__module__}.{getattr(tokenizer, '__qualname__', type(tokenizer).__name__)}"


def fingerprint(size: int, overlap: int, unit: str, tokenizer: Callable[[str], int] | None = None) -> str:
    return hashlib.sha256("|".join((CHUNKER_VERSION, str(size), str(overlap), unit, tokenizer_name(tokenizer))).encode()).hexdigest()


def _is_content(level: Column, text: Column) -> Column:
    return (level == "content") & (t.trim(F.coalesce(text, F.lit(""))) != "")


@cache
def _kinds():
    """Of each code point: 0 white space, 1 of a word, 2 any other."""
    import numpy as np

    kinds, every = np.full(0x110000, 2, np.uint8), "".join(map(chr, range(0x110000)))
    for kind, pattern in ((0, r"\s+"), (1, r"\w+")):
        for run in re.finditer(pattern, every):
            kinds[run.start() : run.end()] = kind
    return kinds


def token_counts(texts: list[str]) -> list[int]:
    """How many TOKENS each text has, of all texts at once."""
    import numpy as np

    if not texts:
        return []
    kinds = _kinds()[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = kinds > 0
    begins[1:] &= (kinds[1:] == 2) | (kinds[:-1] != 1)
    sums = np.concatenate(([0], np.cumsum(begins)))
    ends = np.cumsum([len(text) + 1 for text in texts])
    ends[-1] -= 1
    return np.diff(sums[ends], prepend=0).tolist()


def content_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(_is_content(F.col("level"), F.col("text")))


def _split(text: str, size: int, measure: Callable[[str], int], characters: bool) -> list[str]:
    """Pieces of at most ``size``: words are packed; one word too long is sliced, or grown a character at a time."""
    if measure(text) <= size:
        return [text]
    words = text.split()
    if len(words) > 1:
        pieces, line = [], ""
        for word in words:
            longer = f"{line} {word}" if line else word
            if line and measure(longer) > size:
                pieces += _split(line, size, measure, characters)
                line = word
            else:
                line = longer
        return pieces + _split(line, size, measure, characters)
    if characters:
        return [text[at : at + size] for at in range(0, len(text), size)]
    pieces, part = [], ""
    for character in text:
        if measure(part + character) <= size:
            part += character
        elif part:
            pieces.append(part)
            part = character
        else:
            raise ChunkingError("one character measures more than the chunk size")
    return pieces + [part] * bool(part)


def _atoms(nodes: list, size: int, measure: Callable[[str], int], characters: bool) -> list[tuple]:
    """(separator, text, node) of a group's sentences and their pieces."""
    found = []
    for place, node in enumerate(nodes):
        sentences = [part for raw in SENTENCES.split(node["text"]) if (part := raw.strip())]
        for nth, sentence in enumerate(sentences):
            pieces = _split(sentence, size, measure, characters)
            sliced = characters and len(sentence.split()) == 1
            for k, piece in enumerate(pieces):
                before = ("" if sliced else " ") if k else " " if nth else "\n\n" if place else ""
                found.append((before, piece, node))
    return found


def _packed(found: list[tuple], size: int, overlap: int, measure: Callable[[str], int], additive: bool):
    """Spans (start, end) of atoms; each is the longest that fits, and the next one begins within the overlap.

    For measures that add up, a run's measure is a difference of sums.
    """
    if additive:
        marks, sums = [measure(before) for before, _, _ in found], [0]
        for mark, (_, text, _) in zip(marks, found):
            sums.append(sums[-1] + mark + measure(text))
        span = lambda a, b: sums[b] - sums[a] - marks[a]
    else:
        span = lambda a, b: measure(_joined(found, a, b))
    start, last = 0, len(found)
    while start < last:
        end = start
        while end < last and span(start, end + 1) <= size:
            end += 1
        if end == start:
            raise ChunkingError("an atom measures more than the chunk size")
        yield start, end
        if end == last:
            return
        following = end
        while overlap and following - 1 > start and span(following - 1, end) <= overlap:
            following -= 1
        start = max(start + 1, following)


def _joined(found: list[tuple], start: int, end: int) -> str:
    return found[start][1] + "".join(before + text for before, text, _ in found[start + 1 : end])


def chunk_nodes(document_id: str, nodes: list, size: int = 1000, overlap: int = 150, unit: str = "characters", tokenizer: Callable[[str], int] | None = None) -> list[dict]:
    """Chunks of one document from its content nodes, in any order."""
    check_sizes(size, overlap, unit)
    characters = unit == "characters"
    count = lambda text: len(TOKENS.findall(text))
    measure = len if characters else tokenizer or count
    print_ = fingerprint(size, overlap, unit, tokenizer)
    nodes = sorted((n for n in nodes if n["level"] == "content" and (n["text"] or "").strip()), key=lambda n: (n["sequence"], n["page_start"], n["node_id"]))
    chunks: list[dict] = []
    for _, group in groupby(nodes, key=lambda n: (n["parent_id"], tuple(n["section_path"]))):
        found = _atoms(list(group), size, measure, characters)
        for start, end in _packed(found, size, overlap, measure, characters or tokenizer is None):
            text, first = _joined(found, start, end), found[start][2]
            pages, path = [node["page_start"] for _, _, node in found[start:end]], list(first["section_path"])
            place = (document_id, print_, first["parent_id"] or "", "/".join(path), str(len(chunks)), str(min(pages)), str(max(pages)), text)
            chunks.append({
                "chunk_id": hashlib.sha256("\x1f".join(place).encode()).hexdigest(), "document_id": document_id, "parent_id": first["parent_id"] or first["node_id"],
                "level": first["level"], "section_title": first["section_title"], "section_path": path, "previous_chunk_id": None, "next_chunk_id": None,
                "page_start": min(pages), "page_end": max(pages), "sequence": len(chunks), "text": text, "chunk_size": measure(text), "size_unit": unit,
                "token_count": 0, "content_hash": hashlib.sha256(text.encode()).hexdigest(), "configuration_fingerprint": print_, "chunker_version": CHUNKER_VERSION,
            })
    for chunk, tokens in zip(chunks, token_counts([chunk["text"] for chunk in chunks])):
        chunk["token_count"] = tokens
    for one, two in zip(chunks, chunks[1:]):
        if one["section_path"] == two["section_path"]:
            one["next_chunk_id"], two["previous_chunk_id"] = two["chunk_id"], one["chunk_id"]
    return chunks


def chunk_rows(nodes: DataFrame, size: int = 1000, overlap: int = 150, unit: str = "characters", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of all documents from their hierarchy nodes, with a column error; a document that fails has one row with its id and error alone."""
    return chunk_trees(gathered(content_nodes(nodes), CHUNKED), size, overlap, unit, tokenizer)


def gathered(nodes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row a document: document_id and its nodes."""
    return nodes.groupBy("document_id").agg(F.collect_list(F.struct(*fields)).alias("nodes"))


def chunk_trees(trees: DataFrame, size: int = 1000, overlap: int = 150, unit: str = "characters", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """As ``chunk_rows``, from gathered nodes, which needn't move."""
    check_sizes(size, overlap, unit)
    ship_package(trees.sparkSession)
    content = F.filter("nodes", lambda n: _is_content(n["level"], n["text"]))
    rows = trees.select("document_id", F.transform(content, lambda n: F.struct(*(n[name].alias(name) for name in CHUNKED))).alias("nodes")).where(F.size("nodes") > 0)
    schema = schemas.struct(schemas.CHUNK + ", error string")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, characters = to_arrow_schema(schema), [], 0
        for batch in batches:
            for document_id, content in zip(*(column.to_pylist() for column in batch.columns)):
                try:
                    found = chunk_nodes(document_id, content, size, overlap, unit, tokenizer)
                except Exception as failure:  # noqa: BLE001  a tokenizer may raise anything; only the class is told
                    found = [{"document_id": document_id, "error": type(failure).__name__}]
                held += found
                characters += sum(len(row.get("text", "")) for row in found)
                if characters > BATCH_CHARACTERS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held, characters = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return rows.mapInArrow(run, schema)


def chunk_documents(nodes: DataFrame, size: int = 1000, overlap: int = 150, unit: str = "characters", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks of the documents that can be chunked; ``chunk_rows`` tells of the others."""
    return chunk_rows(nodes, size, overlap, unit, tokenizer).where("error is null").drop("error")


def check_pages(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Content nodes whose page range is empty or has a page the document lacks."""
    pages = documents.select("document_id", F.col("pages.page_number").alias("_pages"))
    span = F.sequence("page_start", "page_end")
    wrong = (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start"))
    return content_nodes(nodes).join(pages, "document_id", "left").where(wrong | F.col("_pages").isNull() | (F.size(F.array_except(F.when(~wrong, span), "_pages")) > 0)).drop("_pages")
