import random

import pytest
from pyspark.sql import functions as F

from gleanery import schemas
from gleanery.operators import chunking, hierarchy


def document(name, *pages, title=None, outlines=(), page_count=None):
    metadata = dict.fromkeys(schemas.METADATA_KEYS) | {"title": title}
    rows = [(k, text, []) for k, text in enumerate(pages, 1)]
    return (name, f"{name}.txt", f"{name}.txt", "0", page_count if page_count is not None else len(pages), metadata, rows, "extracted", [], list(outlines))


def frame(spark, *documents):
    return spark.createDataFrame(list(documents), schemas.struct(schemas.DOCUMENT))


def nodes_of(spark, *documents):
    return [r.asDict() for r in hierarchy.detect_hierarchy(frame(spark, *documents)).orderBy("document_id", "sequence").collect()]


def test_numbered_chapter_and_uppercase_headings(spark):
    text = "Intro line\nChapter 1: Start\nbody one\nbody two\n\nbody three\n1.1 Details here\ntext\nOVERALL RESULTS\nend\n1. Not a heading because it ends.\n"
    found = nodes_of(spark, document("a", text, title="Book"))
    assert [(n["level"], n["section_title"]) for n in found] == [
        ("document", "Book"), ("content", None), ("chapter", "Chapter 1 Start"), ("content", None), ("content", None), ("subsection", "1.1 Details here"),
        ("content", None), ("section", "OVERALL RESULTS"), ("content", None),
    ]
    assert [n["text"] for n in found if n["text"]] == ["Intro line", "body one body two", "body three", "text", "end 1. Not a heading because it ends."]
    assert found[6]["section_path"] == ["Book", "Chapter 1 Start", "1.1 Details here"]
    assert found[6]["parent_id"] == found[5]["node_id"] and found[5]["parent_id"] == found[2]["node_id"] and found[1]["parent_id"] == found[0]["node_id"]
    assert [n["confidence"] for n in found if n["section_title"]] == [None, 0.9, 0.85, 0.65]


def test_outlines_come_first_and_pages_are_the_fallback(spark):
    with_outline = document("a", "CHAPTER TITLE TEXT\nhello there", "more text", outlines=[("One", 1, 0, 0), ("Deep", 2, 3, 1), (" ", 1, 0, 2), ("Far", 9, 0, 3)])
    plain = document("b", "some words\n\nother words", "second page", "")
    found = nodes_of(spark, with_outline, plain)
    a = [n for n in found if n["document_id"] == "a"]
    assert [n["section_title"] for n in a] == ["a.txt", "One", None, "Deep", None]
    assert a[3]["parent_id"] == a[1]["node_id"] and a[3]["level"] == "subsection"
    assert (a[1]["page_start"], a[1]["page_end"]) == (1, 2)
    b = [n for n in found if n["document_id"] == "b"]
    assert [(n["level"], n["section_title"], n["page_start"]) for n in b] == [("document", "b.txt", 1), ("page", "Page 1", 1), ("content", None, 1), ("content", None, 1), ("page", "Page 2", 2), ("content", None, 2), ("page", "Page 3", 3)]
    assert b[0]["page_end"] == 3


def test_warnings(spark):
    rows = frame(spark, document("a", "plain", outlines=[("", 1, 0, 0)]), document("b", "CHAPTER 1\nx"))
    found = {r[0]: r[1] for r in hierarchy.hierarchy_warnings(rows, hierarchy.detect_hierarchy(rows)).collect()}
    assert found == {"a": [hierarchy.NO_OUTLINE, hierarchy.NO_HEADINGS], "b": []}


def test_ids_are_stable_and_unique(spark):
    one = nodes_of(spark, document("a", "Part 2 Two\nx\n\ny"))
    assert one == nodes_of(spark, document("a", "Part 2 Two\nx\n\ny"))
    assert len({n["node_id"] for n in one}) == len(one)


def test_stack_positions_follow_a_stack(spark):
    rng = random.Random(1)
    depths = {f"d{k}": [rng.randint(1, 6) for _ in range(rng.randint(1, 12))] for k in range(60)}
    rows = spark.createDataFrame([(d, k, x) for d, xs in depths.items() for k, x in enumerate(xs)], "document_id string, place int, depth int")
    found = {(r["document_id"], r["place"]): r["position"] for r in hierarchy.stack_positions(rows, ["place"]).collect()}
    for name, values in depths.items():
        stack = []
        for place, depth in enumerate(values):
            stack = stack[: depth - 1] + [place]
            assert found[name, place] == len(stack)


def content(text, sequence=1, parent="p", path=("root",), page=1):
    return {"node_id": f"n{sequence}", "parent_id": parent, "level": "content", "section_title": None, "section_path": list(path), "page_start": page, "sequence": sequence, "text": text}


def test_chunks_stay_in_their_section():
    chunks = chunking.chunk_nodes("d", [content("Aa bb."), content("Cc dd.", 2, page=2), content("Ee.", 3, "q", ("root", "s"))], 100, 10)
    assert [c["text"] for c in chunks] == ["Aa bb.\n\nCc dd.", "Ee."]
    assert [(c["page_start"], c["page_end"]) for c in chunks] == [(1, 2), (1, 1)]
    assert chunks[0]["next_chunk_id"] is None and len({c["chunk_id"] for c in chunks}) == 2


def test_overlap_and_links():
    chunks = chunking.chunk_nodes("d", [content("One two. Three. Four five. Six.")], 20, 8)
    assert [c["text"] for c in chunks] == ["One two. Three.", "Three. Four five.", "Six."]
    assert chunks[0]["next_chunk_id"] == chunks[1]["chunk_id"] and chunks[2]["previous_chunk_id"] == chunks[1]["chunk_id"]
    # A suffix that fits the overlap but not with the next atom is a chunk of its own.
    assert [c["text"] for c in chunking.chunk_nodes("d", [content("Aaaaaaaaaa. Bbbbbb. Cccccccccccccccc.")], 20, 8)] == ["Aaaaaaaaaa. Bbbbbb.", "Bbbbbb.", "Cccccccccccccccc."]


def test_long_words_and_tokens():
    assert [c["text"] for c in chunking.chunk_nodes("d", [content("x" * 23)], 8, 0)] == ["x" * 8, "x" * 8, "x" * 7]
    assert [c["text"] for c in chunking.chunk_nodes("d", [content("alpha beta gamma delta")], 2, 0, "tokens")] == ["alpha beta", "gamma delta"]
    with pytest.raises(chunking.ChunkingError):
        chunking.chunk_nodes("d", [content("ab")], 1, 0, "tokens", lambda text: 2 * len(text))
    for bad in ((0, 0, "characters"), (5, 5, "characters"), (5, 0, "lines")):
        with pytest.raises(chunking.ChunkingError):
            chunking.check_sizes(*bad)


def test_a_document_that_fails_fails_alone(spark):
    def odd(text):
        if "bad" in text:
            raise OSError
        return len(text)

    rows = frame(spark, document("a", "One two."), document("b", "A bad one."))
    found = {r["document_id"]: (r["text"], r["error"]) for r in chunking.chunk_rows(hierarchy.detect_hierarchy(rows), 50, 0, "tokens", odd).collect()}
    assert sorted(found.values(), key=str) == [("One two.", None), (None, "OSError")]


def test_documents_are_chunked_in_spark(spark):
    rows = frame(spark, document("a", "CHAPTER 1\nOne two. Three.\n\nFour."), document("b", ""))
    nodes = hierarchy.detect_hierarchy(rows)
    found = chunking.chunk_documents(nodes, 10, 0).orderBy("sequence").collect()
    assert [r["text"] for r in found] == ["One two.", "Three.", "Four."]
    assert found[0]["section_path"] == ["a.txt", "CHAPTER 1"]
    assert chunking.check_pages(nodes, rows).count() == 0
    assert chunking.check_pages(nodes.withColumn("page_end", F.lit(7)), rows).count() == 2


def test_tokens_are_counted_as_by_the_pattern_and_batches_keep_all_chunks(spark, monkeypatch):
    texts = ["", "a", "_é1 ß.", "x\x1cy\x85z\u3000\u200b", "\n\n", "日本 語!?", "a\U0001d7d8 😀😀b", "́ áb", "end-"]
    assert chunking.token_counts([]) == [] and chunking.token_counts(texts) == [len(chunking.TOKENS.findall(text)) for text in texts]
    every = ["".join(map(chr, (k for k in range(start, start + 64) if not 0xD800 <= k < 0xE000))) for start in range(0, 0x110000, 64)]
    assert chunking.token_counts(every) == [len(chunking.TOKENS.findall(text)) for text in every]
    monkeypatch.setattr(chunking, "BATCH_CHARACTERS", 50)
    ddl = "document_id string, node_id string, parent_id string, level string, section_title string, section_path array<string>, page_start int, sequence int, text string"
    rows = [(f"d{k}", f"n{k}", "p", "content", None, ["s"], 1, 1, f"w{k} " * k) for k in range(30)]
    nodes = spark.createDataFrame(rows, ddl).coalesce(1)
    found = {}
    for row in chunking.chunk_rows(nodes, 20, 0).orderBy("document_id", "sequence").collect():
        found.setdefault(row["document_id"], []).append(row["text"])
    assert {k: " ".join(v) for k, v in found.items()} == {f"d{k}": " ".join([f"w{k}"] * k) for k in range(1, 30)}
