"""Line dedup against levelled, sorted runs of line hashes.

A run is a table of line hashes, hash-bucketed and sorted by them, with the number of
documents seen and the id that keeps the line. A batch of documents is counted by hash,
merge-anti-joined with the runs, whose buckets need no shuffle, so that lines which are
known to be frequent leave, and the rest is written as a run of the lowest level. When
a level has ``FANOUT`` runs they are merged into one of the next level, so that a
batch meets a logarithm of runs. Hashes have 128 bits.

A table is dealt into batches by descending id, so that a line's first batch has the
largest id that holds it. What stays is decided when all batches are in: only hashes,
ids and places move until then, and each document's text moves once, to the places of
its lines that go.

Edge cases: a null text counts as empty and has one empty line; rows that are equal in
id and text count as one document, other rows of one id as several, and all rows
of the id that keeps a line keep it; rows without an id count as documents but never
keep a line that a row with an id has; a line that only rows without ids hold stays in
all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import new_folder, shuffle_width, small_or_merged

#: White space that is stripped from a line's ends.
SPACE = " \t\n\x0b\x0c\r"
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Batches that a table is dealt into.
BATCHES = 4
KEY = ("_h1", "_h2")


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(SPACE))
    # On ASCII alone the quicker function does the same.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """A row for each line whose key has at least ``min_chars`` code points: _id, _of (the text's hash), _at (from 0) and the key's hash."""
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_of", F.xxhash64("_text"))
    lines = texts.select("_id", "_of", F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
    keys = lines.select("_id", "_of", "_at", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    return keys.select("_id", "_of", "_at", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"))


class LineRuns:
    """Runs of line hashes (_h1, _h2, n, keep_id) in a folder that all executors share.

    A line is settled once one run counts ``min_documents`` documents of it: later
    batches leave it out, and the id that keeps it is final. Until then the largest id counts.
    """

    def __init__(self, spark: SparkSession, folder: str, min_documents: int = 3, fanout: int = FANOUT):
        if min_documents < 1 or fanout < 2:
            raise ValueError("min_documents is at least 1 and fanout at least 2")
        self.spark, self.folder, self.min_documents, self.fanout = spark, folder, min_documents, fanout
        self.buckets = shuffle_width(spark)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Takes a batch of ``line_rows`` in as a run."""
        documents = lines.select(*KEY, "_id", "_of").distinct()
        fresh = documents.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("keep_id"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n") >= self.min_documents).select(*KEY).hint("merge"), list(KEY), "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._written(rows))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._put(level + 1, merged)

    def _written(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a bucketed and sorted table, which needs a name while it is written and read."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.select(*KEY, "n", "keep_id").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", f"{self.folder}/{name}").saveAsTable(name)
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone: its files are outside the warehouse
        return table

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several: a merge of sorted buckets, as each has a line once."""
        rows = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("n").alias("_n"), F.col("keep_id").alias("_keep_id"))
            both = rows.join(other.hint("merge"), list(KEY), "full_outer")
            rows = both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("keep_id", "_keep_id").alias("keep_id"))
        return rows

    def frequent(self) -> DataFrame:
        """Lines of at least ``min_documents`` documents: _h1, _h2, keep_id."""
        runs = self.runs()
        rows = runs[0] if len(runs) == 1 else self._merged(runs)
        return rows.where(F.col("n") >= self.min_documents).select(*KEY, "keep_id")


def in_batches(lines: DataFrame, ids: DataFrame, folder: str, batches: int) -> list[DataFrame]:
    """``lines`` written once, dealt by descending id, as many of ``ids`` (_id) each; rows without an id come last."""
    spark = lines.sparkSession
    ranks = [k / batches for k in range(1, batches)]
    bounds = ids.select(F.percentile_approx("_id", ranks, 10_000).alias("b")).first()["b"] if ranks else None
    batch = sum((F.coalesce((F.col("_id") <= bound).cast("int"), F.lit(1)) for bound in bounds or []), F.lit(0))
    lines.withColumn("_batch", batch).write.partitionBy("_batch").parquet(folder)
    kept = spark.read.schema(T.StructType([*lines.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(folder)
    return [kept.where(F.col("_batch") == k).drop("_batch") for k in range(batches)]


def without_lines(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents without the lines at the places in ``gone`` (_id, _of, _gone: sorted, from 0)."""
    texts = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_own", F.xxhash64("_text"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_of"))
    lines = F.split("_text", "\n")
    joined = texts.join(gone.hint("merge"), same, "left").withColumn("n_lines", F.size(lines).cast("long"))
    # What stays are the runs of lines between those that go.
    edges = lambda: F.zip_with(F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.col("n_lines").cast("int"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = lambda all_lines: F.transform(edges(), lambda x: F.slice(all_lines, x["a"] + 2, x["b"] - x["a"] - 1))
    stays = F.get(F.transform(F.array(lines), lambda all_lines: F.array_join(F.flatten(between(all_lines)), "\n")), F.lit(0))
    return joined.select(
        id_col, "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(stays).alias("clean_text"),
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_documents: int = 3, batches: int = BATCHES) -> DataFrame:
    """One row a document (a numeric id): id, n_lines, n_dropped and clean_text.

    Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_documents`` documents stay in the largest id that holds them only.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "line-dedup")
    dealt = in_batches(line_rows(df, id_col, text_col, min_chars), df.select(F.col(id_col).alias("_id")), f"{folder}/lines", batches)
    runs = LineRuns(spark, f"{folder}/runs", min_documents)
    for batch in dealt:
        runs.add(batch)
    lines = dealt[0]
    for batch in dealt[1:]:
        lines = lines.unionByName(batch)
    leaving = lines.join(small_or_merged(runs.frequent()), list(KEY)).where(~F.col("_id").eqNullSafe(F.col("keep_id")))
    gone = leaving.groupBy("_id", "_of").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))
    return without_lines(df, gone, id_col, text_col)
