"""Section structure of documents: headings, their stack, paragraphs and a node tree.

Texts are dealt by document once. Everything else is sorts, windows and folds within that: the
heading stack has a closed form, paragraphs are islands between breaks, and the
ids, which hash their parents' ids, come from one fold over a document's headings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as t

#: What headings look like, by the first pattern that holds.
CHAPTER = r"(?i)^\s*((?:chapter|part)\s+\d+[A-Za-z]?)\s*[:.\-]?\s*(.*?)\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+){0,5})[.)]?\s+(.{2,120}?)\s*$"
UPPERCASE = r"^[A-Z][A-Z0-9 &/,:()'\-]{2,80}$"
SENTENCE_END = r"[.!?;:]$"
#: Goes up when documents get other nodes than before.
HIERARCHY_VERSION = "1"
#: Headings nest this deep when they are told from text.
DEEPEST = 6
NO_HEADINGS = "no_headings_detected_page_paragraph_fallback_used"
NO_OUTLINE = "outline_unusable_fell_back_to_text_patterns"


def heading_of(line: Column) -> Column:
    """struct(title, depth, method, confidence) of a trimmed line, by the first rule that holds; else null."""
    chapter = line.rlike(CHAPTER)
    name, rest = F.regexp_extract(line, CHAPTER, 1), F.regexp_extract(line, CHAPTER, 2)
    number, title = F.regexp_extract(line, NUMBERED, 1), t.trim(F.regexp_extract(line, NUMBERED, 2))
    numbered = line.rlike(NUMBERED) & ~title.rlike(SENTENCE_END)
    uppercase = (F.length(line) <= 81) & line.contains(" ") & line.rlike(UPPERCASE) & ~line.rlike(SENTENCE_END)
    depth = F.least(F.size(F.split(number, r"\.")), F.lit(DEEPEST))

    def found(title: Column, depth: Column, method: str, confidence: float) -> Column:
        return F.struct(title.alias("title"), depth.cast("int").alias("depth"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    return (
        F.when(chapter, found(F.trim(F.concat_ws(" ", name, F.when(rest != "", rest))), F.lit(1), "chapter_pattern", 0.9))
        .when(numbered, found(F.concat_ws(" ", number, title), depth, "numbered_heading_pattern", 0.85))
        .when(uppercase, found(line, F.lit(1), "uppercase_heading_pattern", 0.65))
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """One row a line: document_id, page, line (from 0), text (trimmed)."""
    pages = documents.select("document_id", F.explode("pages").alias("p"))
    return pages.select("document_id", F.col("p.page_number").alias("page"), F.posexplode(t.lines(F.col("p.text"))).alias("line", "raw")).select("document_id", "page", "line", t.trim(F.col("raw")).alias("text"))


def outline_headings(documents: DataFrame) -> DataFrame:
    """Usable outline entries as headings: document_id, page, place, title, depth, method, confidence."""
    entries = documents.select("document_id", "page_count", F.explode("outlines").alias("o"))
    usable = entries.where((t.trim(F.col("o.title")) != "") & F.col("o.page_number").between(1, F.col("page_count")))
    return usable.select(
        "document_id", F.col("o.page_number").alias("page"), F.col("o.order").alias("place"), t.trim(F.col("o.title")).alias("title"),
        F.greatest(F.lit(1), F.col("o.level") + 1).alias("depth"), F.lit("pdf_outline").alias("method"), F.lit(1.0).alias("confidence"),
    )


def text_headings(lines: DataFrame) -> DataFrame:
    """Headings among lines, in the same columns."""
    return lines.where(F.col("text") != "").withColumn("h", heading_of(F.col("text"))).where(F.col("h").isNotNull() & (F.col("h.title") != "")).select("document_id", "page", F.col("line").alias("place"), "h.title", "h.depth", "h.method", "h.confidence")


def stack_positions(headings: DataFrame, order: list[str]) -> DataFrame:
    """``headings`` with nth (from 1, in ``order``) and position on the heading stack.

    A heading of depth d stands at position d, or right above the stack if that is
    lower: position = nth + min(0, least of (depth - nth) so far).
    """
    by = Window.partitionBy("document_id").orderBy(*order)
    numbered = headings.withColumn("nth", F.row_number().over(by))
    return numbered.withColumn("position", F.col("nth") + F.least(F.lit(0), F.min(F.col("depth") - F.col("nth")).over(Window.partitionBy("document_id").orderBy("nth"))))


def level_of(method: Column, depth: Column) -> Column:
    return F.when(method == "chapter_pattern", "chapter").when(depth <= 1, "section").otherwise("subsection")


def node_id(document_id, parent_id, level, title, path, page, sequence, text) -> Column:
    return t.sha256(document_id, parent_id, level, title, F.array_join(path, "/"), page, sequence, text)


def _entries() -> Column:
    """A document's root, outline, pages and lines as one array of (page, kind, place, text, o), by kind.

    kind -1: the root; 0: a page; 1: a usable outline entry; 2: a line. With an outline, text has no headings.
    """
    nothing = F.lit(None).cast("struct<title:string,level:int>")
    row = lambda page, kind, place, text, o=nothing: F.struct(page.cast("int").alias("page"), F.lit(kind).alias("kind"), place.cast("int").alias("place"), text.cast("string").alias("text"), o.alias("o"))
    root = F.array(row(F.lit(0), -1, F.lit(0), F.lit(None)))
    outline = F.transform("_outline", lambda o: row(o["page_number"], 1, o["order"], F.lit(None), F.struct(t.trim(o["title"]).alias("title"), o["level"].alias("level"))))
    pages = F.transform("pages", lambda p: row(p["page_number"], 0, F.lit(0), F.lit(None)))
    of_page = lambda p: F.transform(t.lines(p["text"]), lambda line, k: row(p["page_number"], 2, k, t.trim(line)))
    return F.concat(root, outline, pages, F.flatten(F.transform("pages", of_page)))


def events(documents: DataFrame) -> DataFrame:
    """What becomes nodes, in order: document_id, page, kind, place, sequence (0: the root) and details.

    kind -1: the root; 0: the page of a document without headings; 1: an outline heading; 2: a
    heading or a paragraph of the text. Texts are dealt by document once, and all that follows
    is sorted within that.
    """
    usable = lambda o: (t.trim(o["title"]) != "") & o["page_number"].between(1, F.col("page_count"))
    whole = documents.repartition("document_id").select("document_id", "page_count", "pages", F.filter("outlines", usable).alias("_outline"))
    rows = whole.select("document_id", (F.size("_outline") > 0).alias("_outlined"), F.inline(_entries()))
    of_text = F.when((F.col("kind") == 2) & ~F.col("_outlined") & (F.col("text") != ""), heading_of(F.col("text")))
    of_outline = F.struct(F.col("o.title").alias("title"), F.greatest(F.lit(1), F.col("o.level") + 1).cast("int").alias("depth"), F.lit("pdf_outline").alias("method"), F.lit(1.0).alias("confidence"))
    known = rows.withColumn("h", F.when(F.col("kind") == 1, of_outline).otherwise(of_text)).withColumn("h", F.when(F.col("h.title") != "", F.col("h")))
    known = known.withColumn("_broken", (F.col("kind") < 2) | F.col("h").isNotNull() | (F.col("text") == ""))
    in_order = Window.partitionBy("document_id").orderBy("page", "kind", "place")
    marked = known.withColumn("_island", F.sum(F.col("_broken").cast("int")).over(in_order)).where((F.col("kind") < 2) | (F.col("text") != ""))
    # A heading stands alone; the lines between two breaks of a page are a paragraph.
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    found = marked.groupBy("document_id", "page", "kind", "_island", "_broken").agg(F.min("place").alias("place"), F.first("h").alias("h"), lines.alias("text"))
    headed = F.max(F.col("h").isNotNull()).over(Window.partitionBy("document_id"))
    kept = found.withColumn("_headed", headed).where((F.col("kind") != 0) | ~F.col("_headed"))
    page = F.struct(F.concat(F.lit("Page "), F.col("page")).alias("title"), F.lit(1).alias("depth"), F.lit("page_fallback").alias("method"), F.lit(None).cast("double").alias("confidence"))
    numbered = kept.withColumn("sequence", F.row_number().over(in_order) - 1).withColumn("h", F.when(F.col("kind") == 0, page).otherwise(F.col("h")))
    is_text = (F.col("kind") == 2) & F.col("h").isNull()
    return numbered.select(
        "document_id", "page", "kind", "place", "sequence", "h.title", "h.depth", F.when(is_text, "paragraph_content").otherwise(F.col("h.method")).alias("method"), "h.confidence", F.when(is_text, F.col("text")).alias("text"),
    )


def _sections(e: Column, root_id: Column, root_path: Column) -> Column:
    """(id, parent_id, path) of each heading, in order; ids hash their parents' ids."""
    empty = F.array().cast("array<struct<id:string,parent_id:string,path:array<string>>>")

    def push(state: Column, s: Column) -> Column:
        under = F.slice(state["stack"], F.lit(1), s["position"] - 1)
        parent = F.try_element_at(under, F.lit(-1))
        parent_id, path = F.coalesce(parent["id"], root_id), F.concat(F.coalesce(parent["path"], root_path), F.array(s["title"]))
        own = node_id(F.col("document_id"), parent_id, s["level"], s["title"], path, s["page"], s["sequence"], F.lit(None))
        node = F.array(F.struct(own.alias("id"), parent_id.alias("parent_id"), path.alias("path")))
        return F.struct(F.concat(under, node).alias("stack"), F.concat(state["out"], node).alias("out"))

    return F.aggregate(e, F.struct(empty.alias("stack"), empty.alias("out")), push, lambda s: s["out"])


def _ends(e: Column, last_page: Column) -> Column:
    """The last page of each heading's section, in order: that before the next heading at its position or above.

    One fold from the end; ``near`` has that page for each position.
    """
    none = F.array().cast("array<int>")

    def back(state: Column, s: Column) -> Column:
        near, above = state["near"], s["position"] - 1
        deepest = F.coalesce(F.try_element_at(near, F.lit(-1)), last_page)
        own = F.coalesce(F.try_element_at(near, s["position"]), deepest)
        padded = F.concat(F.slice(near, F.lit(1), above), F.array_repeat(deepest, F.greatest(F.lit(0), above - F.size(near))), F.array(s["before"]))
        return F.struct(padded.alias("near"), F.concat(F.array(F.greatest(own, s["page"])), state["out"]).alias("out"))

    return F.aggregate(F.reverse(e), F.struct(none.alias("near"), none.alias("out")), back, lambda s: s["out"])


def detect_hierarchy(documents: DataFrame) -> DataFrame:
    """The node tree of each document, one row a node.

    One exchange deals the texts by document and a second the few columns of the roots; the rest are sorts,
    windows and folds within a document.
    """
    nothing = F.lit(None).cast("string")
    root_title = F.coalesce(F.nullif(F.try_element_at("metadata", F.lit("title")), F.lit("")), "source_filename")
    roots = documents.select("document_id", F.greatest(F.lit(1), F.col("page_count")).alias("_root_end"), root_title.alias("_root_title"))
    # Sections are the headings, or else the pages, which never nest; nth counts them.
    by = Window.partitionBy("document_id").orderBy("sequence")
    level = F.when(F.col("title").isNull(), "content").when(F.col("method") == "page_fallback", "page").otherwise(level_of(F.col("method"), F.col("depth")))
    numbered = events(documents).withColumns({"level": level, "nth": F.count("title").over(by), "before": F.lag("page").over(by)})
    placed = numbered.withColumn("position", F.col("nth") + F.least(F.lit(0), F.min(F.col("depth") - F.col("nth")).over(by)))
    event = F.struct("sequence", "page", F.col("nth").cast("int").alias("nth"), F.col("position").cast("int").alias("position"), "before", "level", "title", "method", "confidence", "text")
    gathered = placed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.col("sequence") > 0, event))).alias("e"), F.max("page").alias("_last_page")).join(roots.hint("merge"), "document_id")
    root_path = F.array("_root_title")
    gathered = gathered.withColumn("_root_id", node_id(F.col("document_id"), nothing, F.lit("document"), F.col("_root_title"), root_path, F.lit(1), F.lit(0), nothing))

    def row(id, parent_id, level, title, path, start, end, sequence, method, confidence, text) -> Column:
        of = {"node_id": id, "parent_id": parent_id, "level": level, "section_title": title, "section_path": path, "page_start": start, "page_end": end, "sequence": sequence, "detection_method": method, "confidence": confidence, "text": text}
        kinds = {"page_start": "int", "page_end": "int", "sequence": "int", "confidence": "double", "section_path": "array<string>"}
        return F.struct(*(value.cast(kinds.get(name, "string")).alias(name) for name, value in of.items()))

    def node(x: Column, e: Column) -> Column:
        section, is_section = F.get(x["tree"], e["nth"] - 1), e["title"].isNotNull()
        path = F.coalesce(section["path"], root_path)
        above = F.coalesce(section["id"], F.col("_root_id"))
        as_section = row(section["id"], section["parent_id"], e["level"], e["title"], path, e["page"], F.get(x["ends"], e["nth"] - 1), e["sequence"], e["method"], e["confidence"], nothing)
        own = node_id(F.col("document_id"), above, e["level"], nothing, path, e["page"], e["sequence"], e["text"])
        return F.when(is_section, as_section).otherwise(row(own, above, e["level"], nothing, path, e["page"], e["page"], e["sequence"], e["method"], e["confidence"], e["text"]))

    heads = F.filter("e", lambda x: x["title"].isNotNull())
    # Bound by a lambda, so that the folds run once a document, not once a node.
    folded = F.struct(_sections(heads, F.col("_root_id"), root_path).alias("tree"), _ends(heads, F.col("_last_page")).alias("ends"), F.col("e").alias("e"))
    below = F.get(F.transform(F.array(folded), lambda x: F.transform(x["e"], lambda e: node(x, e))), F.lit(0))
    top = row(F.col("_root_id"), nothing, F.lit("document"), F.col("_root_title"), root_path, F.lit(1), F.col("_root_end"), F.lit(0), F.lit("document_root"), F.lit(None), nothing)
    columns = ("node_id", "document_id", "parent_id", "level", "section_title", "section_path", "page_start", "page_end", "sequence", "detection_method", "confidence", "text")
    return gathered.select("document_id", F.inline(F.concat(F.array(top), below))).select(*columns)


def hierarchy_warnings(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """document_id and its warnings with those of the detection, each once, in order."""
    methods = nodes.groupBy("document_id").agg(F.bool_or(F.col("detection_method") == "pdf_outline").alias("outlined"), F.bool_or(F.col("level").isin("chapter", "section", "subsection")).alias("headed"))
    none = F.array().cast("array<string>")
    unusable = F.when((F.size("outlines") > 0) & ~F.col("outlined"), F.array(F.lit(NO_OUTLINE))).otherwise(none)
    fallback = F.when(~F.col("headed"), F.array(F.lit(NO_HEADINGS))).otherwise(none)
    return documents.join(methods, "document_id").select("document_id", F.array_distinct(F.concat("warnings", unusable, fallback)).alias("hierarchy_warnings"))
