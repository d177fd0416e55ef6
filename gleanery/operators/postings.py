"""An inverted index for keyword search: postings in blocks, whose bounds let a search skip most of them.

Chunks are numbered in the order that breaks ties, and ``BLOCK`` numbers make a block. A
row of the postings is a piece of text in a block: the numbers of its chunks with their
points, the most points and the first number. Rows are dealt by piece and block, so that a
frequent piece lies in many partitions, and files are sorted by piece, so that a reader skips most of a file.

A piece is a run of ASCII letters, digits and _, or one of the other characters that a term can begin with. A query
term that is one run reads its postings; another is looked up by its longest run, or its first
character, and then looked for in the chunks that have it.

A search merges queries of equal terms. For each set of terms, a block's bound is the sum of the most points of
its terms. The blocks with the highest bounds are scored first; of the others only those are scored that
can still beat the k-th hit found, or tie with it and come before it.

Batches can be added: each has its own numbers and blocks, and of a document's
versions the one of the last batch counts.

Chunks that no index holds are searched by a pass over their texts, which keeps the points of the terms that
are asked for alone: numbers and blocks are made of these few rows, so that no text moves and no other piece is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.folders import exists, scratch
from gleanery.functions import text as t
from gleanery.sizing import partitions_of

#: Chunks of a block.
BLOCK = 1024
#: Blocks of a set of terms that are scored before bounds are compared.
FIRST_BLOCKS = 2
#: Rows, at most, of a table that is sent to every task.
FEW = 200_000
#: Blocks of a task, at most, that reads all entries of an index.
BLOCKS_OF_TASK = 16
#: A run of the characters that bound no term.
RUN = "[A-Za-z0-9_]+"
PIECE = rf"{RUN}|[\p{{L}}\p{{N}}+#]"
CHUNK = "batch int, at long, chunk_id string, document_id string, source_path string, sequence int, body string, title string, path string"
POSTINGS = "batch int, piece string, block long, entries array<struct<at:long,points:int>>, most int, first long"
#: Points of a term in a chunk's fields.
POINTS = {"body": 1, "title": 2, "path": 2}
#: Bits that all of a chunk's points of a term fit.
POINTS_BITS = sum(POINTS.values()).bit_length()


def searched_fields() -> dict[str, Column]:
    """What keyword search reads of a chunk, in lower case."""
    columns = {"body": F.col("text"), "title": F.col("section_title"), "path": t.json_path(F.col("section_path"))}
    return {name: F.lower(F.coalesce(column, F.lit(""))) for name, column in columns.items()}


def _pieces(field: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(field, F.lit(PIECE), F.lit(0)))


def piece_points(chunks: DataFrame) -> DataFrame:
    """at, piece and points of all pieces of numbered chunks (body, title and path in lower case)."""
    found = chunks.select("at", _pieces("body").alias("_body"), _pieces("title").alias("_title"), _pieces("path").alias("_path"))
    # Titles and paths are short: their pieces are tried against the body's, and the body's others have its points.
    found = found.withColumn("_short", F.array_union("_title", "_path"))
    of = lambda name, piece: F.when(F.array_contains(name, piece), POINTS[name.removeprefix("_")]).otherwise(0)
    entry = lambda piece, points: F.struct(piece.alias("piece"), points.cast("int").alias("points"))
    short = F.transform("_short", lambda x: entry(x, of("_body", x) + of("_title", x) + of("_path", x)))
    rest = F.transform(F.array_except("_body", "_short"), lambda x: entry(x, F.lit(POINTS["body"])))
    return found.select("at", F.inline(F.concat(short, rest)))


def longest_run(term: Column) -> Column:
    """The piece that a term is looked up by."""
    runs = F.regexp_extract_all(term, F.lit(RUN), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.coalesce(longest, F.substring(term, 1, 1))


class KeywordIndex:
    """Chunks and postings as tables in a folder, partitioned by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, ddl: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(ddl).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], ddl)

    def add(self, chunks: DataFrame, batch: int = 0, newest: tuple[Column, ...] = ()) -> None:
        """Writes a batch; the same batch again takes its own place, so that a replay changes nothing.

        Chunks have chunk_id, document_id, source_path, sequence, text, section_title and section_path. Of
        chunks that are equal in path, sequence and id the first by ``newest`` counts, where that is given.
        """
        order = ("_order", "sequence", "chunk_id")
        keys = ("chunk_id", "document_id", "source_path", "sequence")
        placed = chunks.withColumn("_order", t.fold(F.col("source_path"))).withColumn("sequence", F.col("sequence").cast("int"))
        if newest:  # by path alone, which the window's partitions keep to whatever else is constant, so that a text moves once
            first = F.row_number().over(Window.partitionBy(*order).orderBy(*newest)) == 1
            sorted_ = placed.repartitionByRange("_order").withColumn("_first", first).where("_first")
        else:
            sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
        self._write(sorted_.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("at"), *keys, *(column.alias(name) for name, column in searched_fields().items())), "chunks")
        written = self._read("chunks", CHUNK).where(F.col("batch") == batch)
        # An entry is a number while it is gathered and sorted, which takes a quarter of a struct's space.
        entry = (F.shiftleft("at", POINTS_BITS) + F.col("points")).alias("entry")
        packed = piece_points(written).select("piece", F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), entry)
        unpacked = lambda x: F.struct(F.shiftright(x, POINTS_BITS).alias("at"), x.bitwiseAND(2**POINTS_BITS - 1).cast("int").alias("points"))
        gathered = packed.groupBy("piece", "block").agg(F.sort_array(F.collect_list("entry")).alias("_entries"))
        gathered = gathered.select("piece", "block", F.transform("_entries", unpacked).alias("entries")).withColumns({"most": F.array_max("entries.points"), "first": F.get("entries", F.lit(0))["at"]})
        self._write(gathered.select(F.lit(batch).alias("batch"), "*").sortWithinPartitions("batch", "piece", "block"), "postings")

    def all_chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    def chunks(self) -> DataFrame:
        """The chunks of each document's last batch."""
        found = self.all_chunks()
        last = found.groupBy("document_id").agg(F.max("batch").alias("batch"))
        return found.join(last, ["document_id", "batch"], "left_semi")

    def postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def entries(self) -> DataFrame:
        """piece, chunk_id, document_id and points of the chunks that count.

        Rows of the postings meet the chunks of their block, so that only blocks are shuffled and no entry by itself.
        """
        found = self.all_chunks().select("batch", "at", "chunk_id", "document_id")
        last = found.groupBy("document_id").agg(F.max("batch").alias("_last"))
        parts = partitions_of(self.spark, found.count(), BLOCKS_OF_TASK * BLOCK)
        dealt = (parts, "batch", "block")
        # A batch's numbers have no gaps in a block: a chunk lies where its number says, or nothing where it has a later version.
        chunk = F.struct("at", F.when(F.col("batch") == F.col("_last"), F.struct("chunk_id", "document_id")).alias("ids"))
        placed = found.join(last, "document_id").select("batch", F.shiftright("at", BLOCK.bit_length() - 1).alias("block"), chunk.alias("chunk"))
        held = placed.repartition(*dealt).groupBy("batch", "block").agg(F.array_sort(F.collect_list("chunk")).alias("_chunks"))
        rows = self.postings().select("batch", "block", "piece", F.col("entries.at").alias("_at"), F.col("entries.points").alias("_points")).repartition(*dealt)
        each = rows.join(held.hint("merge"), ["batch", "block"]).select("piece", "_points", "_chunks", F.posexplode("_at").alias("_n", "at"))
        own = each.select("piece", F.get("_chunks", (F.col("at") % BLOCK).cast("int"))["ids"].alias("ids"), F.get("_points", F.col("_n")).alias("points"))
        return own.where("ids is not null").select("piece", "ids.chunk_id", "ids.document_id", "points")

    def batches(self) -> int:
        return self.all_chunks().select("batch").distinct().count()


def index_of(chunks: DataFrame) -> KeywordIndex:
    """A new index of chunks in a folder of its own."""
    index = KeywordIndex(chunks.sparkSession, scratch(chunks.sparkSession, "keyword-index"))
    index.add(chunks)
    return index


def bounded_points(term: Column) -> Column:
    """Points of a term, a column, in a chunk's lower-cased fields."""
    bounded = F.concat(F.lit("(?:^|[^A-Za-z0-9_])"), F.regexp_replace(term, r"([^\w\s])", r"\\$1"), F.lit("(?:[^A-Za-z0-9_]|$)"))
    return sum((F.when(F.col(name).contains(term) & F.regexp_like(name, bounded), points).otherwise(0) for name, points in POINTS.items()), F.lit(0)).cast("int")


def term_rows(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each chunk and each of ``terms`` (term; at most ``FEW``) that it has, with its points and, as _row, a number of the chunk."""
    wanted = terms.select("term", longest_run(F.col("term")).alias("piece"), F.col("term").rlike(f"^{RUN}$").alias("_whole"))
    keys = ("_row", "chunk_id", "document_id", "source_path", "sequence")
    rows = chunks.select(F.monotonically_increasing_id().alias("_row"), "chunk_id", "document_id", "source_path", F.col("sequence").cast("int").alias("sequence"), *(column.alias(name) for name, column in searched_fields().items()))
    rows = rows.select("*", *(F.regexp_extract_all(name, F.lit(PIECE), F.lit(0)).alias(f"_{name}") for name in POINTS))
    # Outer, as for an inner one Spark would first look whether there are pieces.
    found = rows.withColumn("piece", F.explode_outer(F.array_distinct(F.concat(*(f"_{name}" for name in POINTS))))).join(F.broadcast(wanted), "piece")
    # A term of one run is a piece; another has to be looked for in the text.
    own = sum((F.when(F.array_contains(f"_{name}", F.col("piece")), points).otherwise(0) for name, points in POINTS.items()), F.lit(0))
    return found.select(*keys, "term", F.when(F.col("_whole"), own).otherwise(bounded_points(F.col("term"))).alias("points")).where("points > 0")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``term_rows`` with a number of the chunk in the order of ties, as at; the first row of each chunk is told by its own number, _n."""
    keys = ["_order", "sequence", "chunk_id", "_row"]
    placed = rows.withColumn("_order", t.fold(F.col("source_path"))).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    return placed.select("chunk_id", "document_id", "source_path", "sequence", "term", "points", "_n", F.min("_n").over(Window.partitionBy(*keys)).alias("at"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def term_blocks(index: KeywordIndex, terms: DataFrame, several: bool) -> DataFrame:
    """term, batch, block, entries, most and first of each of ``terms`` (term), as ``postings`` has them of pieces."""
    kinds = terms.select("term", longest_run(F.col("term")).alias("piece"), F.col("term").rlike(f"^{RUN}$").alias("_whole"))
    found = _joined(index.postings(), kinds, ["piece"], terms.limit(FEW + 1).count() <= FEW)
    whole = found.where("_whole").select("term", "batch", "block", "entries", "most", "first")
    candidates = found.where("not _whole").select("term", "batch", "block", F.inline("entries")).drop("points")
    met = candidates.join(index.all_chunks().select("batch", "at", *POINTS), ["batch", "at"]).select("term", "batch", "block", "at", bounded_points(F.col("term")).alias("points")).where("points > 0")
    if several:  # documents may have newer versions
        live = index.chunks().select("batch", "at")
        met = whole.select("term", "batch", "block", F.inline("entries")).unionByName(met).join(live, ["batch", "at"], "left_semi")
    again = met.groupBy("term", "batch", "block").agg(F.array_sort(F.collect_list(F.struct("at", "points"))).alias("entries"), F.max("points").alias("most"), F.min("at").alias("first"))
    return again if several else whole.unionByName(again)


def search(index: KeywordIndex | DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best chunks of each query (query_id, terms), of an index or of chunks: query_id, chunk_id, document_id, source_path, sequence, score, rank."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.array_sort("terms").alias("_terms")).where(F.size("_terms") > 0).withColumn("set_id", F.sha2(F.array_join("_terms", t.UNIT), 256))
    folder = scratch(spark, "keyword-search")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        """Written, as several steps read it."""
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    wanted = kept(asked.select("set_id", F.explode("_terms").alias("term")).distinct(), "terms")
    few = wanted.limit(FEW + 1).count() <= FEW
    if isinstance(index, DataFrame) and few:
        several = False
        rows = kept(numbered_rows(kept(term_rows(index, wanted.select("term").distinct()), "rows")), "numbered")
        block = F.shiftright("at", BLOCK.bit_length() - 1)
        gathered = rows.groupBy("term", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "points"))).alias("entries"), F.max("points").alias("most"), F.min("at").alias("first"))
        blocks = kept(gathered.withColumn("batch", F.lit(0)), "blocks")
        keys = rows.where("_n = at").select(F.lit(0).alias("batch"), "at", "chunk_id", "document_id", "source_path", "sequence")
    else:
        index = index_of(index) if isinstance(index, DataFrame) else index
        several = index.batches() > 1
        blocks = kept(term_blocks(index, wanted.select("term").distinct(), several), "blocks")
        keys = index.all_chunks().select("batch", "at", "chunk_id", "document_id", "source_path", "sequence")
    bounds = _joined(blocks.select("term", "batch", "block", "most", "first"), wanted, ["term"], few).groupBy("set_id", "batch", "block").agg(F.sum("most").alias("bound"), F.max("first").alias("first"))

    def scored(pairs: DataFrame) -> DataFrame:
        """The first ``k`` chunks of each set in the given blocks; the order of numbers is that of ties within a batch."""
        of_terms = _joined(pairs.select("set_id", "batch", "block"), wanted, ["set_id"], few)
        rows = of_terms.join(blocks.select("term", "batch", "block", "entries"), ["term", "batch", "block"]).select("set_id", "batch", F.inline("entries"))
        sums = rows.groupBy("set_id", "batch", "at").agg(F.sum("points").alias("score"))
        return sums.withColumn("_nth", F.row_number().over(Window.partitionBy("set_id", "batch").orderBy(F.desc("score"), "at"))).where(F.col("_nth") <= k).drop("_nth")

    ranked = bounds.withColumn("_nth", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("bound"), "batch", "first", "block")))
    firsts = ranked.where(F.col("_nth") <= FIRST_BLOCKS).drop("_nth")
    found = kept(scored(firsts), "first-hits")
    last = found.withColumn("_nth", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("score"), "batch", "at"))).where(F.col("_nth") == k).select("set_id", F.col("score").alias("_score"), F.col("at").alias("_at"))
    # Numbers of two batches can't be compared, so that ties count there.
    beats = F.col("_score").isNull() | (F.col("bound") > F.col("_score")) | ((F.col("bound") == F.col("_score")) & (F.lit(several) | (F.col("first") < F.col("_at"))))
    more = ranked.where(F.col("_nth") > FIRST_BLOCKS).drop("_nth").join(last, "set_id", "left").where(beats)
    every = found.unionByName(scored(more))
    by = Window.partitionBy("set_id").orderBy(F.desc("score"), t.fold(F.col("source_path")), "sequence", "chunk_id")
    best = every.join(keys, ["batch", "at"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    columns = ("chunk_id", "document_id", "source_path", "sequence", F.col("score").cast("double").alias("score"), "rank")
    return asked.select("query_id", "set_id").join(best, "set_id").select("query_id", *columns)
