"""A corpus from raw documents to packed training sequences.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), with
``docs`` what its predecessor kept, and all but the last return the columns of
``documents``. ``run`` applies them to the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import exact_dedup, packing, quality_rules, simhash, substring_dedup
from gleanery.llm.common import cut, read_table, small_or_merged
from gleanery.llm.queries import WORD_MODEL, vocabulary


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that clash with no operator's, but for id and text, and what they were."""
    names = {name: f"_column_{k}" for k, name in enumerate(docs.columns) if name not in ("doc_id", "text", "n_chars")}
    return docs.select("doc_id", "text", *(F.col(name).alias(own) for name, own in names.items())), names


def _columns(df: DataFrame, docs: DataFrame, names: dict[str, str], text: Column) -> DataFrame:
    """The columns of ``docs`` from ``df``, with another text and its length."""
    found = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")} | {name: F.col(own) for name, own in names.items()}
    return df.select(*(found[name].alias(name) for name in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass, without their failing lines."""
    plain, names = _renamed(docs)
    return _columns(quality_rules.quality_rules(plain, carry=list(names.values())).where("kept"), docs, names, F.col("clean_text"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; of several without an id, one."""
    plain, names = _renamed(docs)
    return _columns(exact_dedup.dedup_exact(plain, carry=["text", *names.values()]).where("stays"), docs, names, F.col("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays."""
    dropped = simhash.verified_groups(docs).select(F.col("doc_id").alias("_dropped"), F.col("node").alias("_node"))
    # By text as well: rows without an id, or with a repeated one, may differ in it.
    same = F.col("doc_id").eqNullSafe(F.col("_dropped")) & (simhash.text_node("text") == F.col("_node"))
    return docs.join(small_or_merged(dropped), same, "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; so do documents of which no word is left."""
    plain, names = _renamed(docs)
    found = substring_dedup.dedup_substrings(plain, carry=list(names.values()))
    return _columns(found.where((F.col("removed_bytes") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]")), docs, names, F.col("clean_text"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 4096 tokens."""
    return packing.pack(packing.cut_pieces(docs, vocabulary(WORD_MODEL)))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", substrings), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        # Written, as stages read their input more than once.
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The packing plan and the line rules are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
