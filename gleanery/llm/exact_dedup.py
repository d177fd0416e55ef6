"""Exact deduplication by a content sort.

Spark samples splitters and range-partitions the (normalised) bytes; each task
sorts its range externally, so that equal texts are neighbours, and neighbours
are compared in full. Splitters are of bounded size, as they pass the driver: the
first bytes of a text, then a number made from all of it, which lets them cut
through a beginning that very many texts share but never through a text. A text
that a sample shows to make up a large part of the rows is dealt over several
ranges; the first rows of its runs, a few for each such text, are then compared in
full among themselves.

Edge cases: a null text counts as empty; equal rows (ties in the id as well) fall
in one group, all rows with the kept id count as ``kept`` and just one row of each
text ``stays``; null ids never win against others; an empty table gives an empty
result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, shuffle_width

#: Bytes of a text that a splitter holds.
SPLITTER_BYTES = 48
#: Rows that are sampled, about, to find texts that make up a large part of all.
SAMPLE_ROWS = 200_000
#: A text is dealt over several ranges if it fills more than this part of one.
LARGE_SHARE = 0.25


def large_texts(rows: DataFrame, parts: int) -> DataFrame:
    """Hashes of texts that would fill a large part of a range, and the ranges (slots) to deal each over.

    At most parts / LARGE_SHARE rows, from a sample; a text that it misses makes a task larger, not a result wrong.
    """
    total = rows.count()
    hashes = rows.select("_hash")
    if total > SAMPLE_ROWS:
        hashes = hashes.sample(False, SAMPLE_ROWS / total, 42)
    share = F.col("count") / F.lit(min(total, SAMPLE_ROWS) or 1)
    found = hashes.groupBy("_hash").count().where((share * parts > LARGE_SHARE) & (F.col("count") >= 8))
    found = found.select("_hash", F.ceil(share * parts / LARGE_SHARE).cast("int").alias("_slots")).orderBy(F.desc("_slots"), "_hash").limit(int(parts / LARGE_SHARE)).collect()
    return rows.sparkSession.createDataFrame([tuple(row) for row in found], "_large long, _slots int")


def dedup_exact(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalize: Callable[[Column], Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: its id, the columns to ``carry`` along, keep_id, group_size, kept, stays, text_sha256 (of the normalised text) and n_bytes.

    ``keep`` names the id that stays of equal texts: ``smallest`` or ``largest``.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    parts = shuffle_width(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A text that is carried unchanged moves once.
    whole = [k for k, name in enumerate(carry) if name == text_col and normalize is None]
    moved = [F.col(name).isNull().alias(f"_carried_{k}") if k in whole else F.col(name).alias(f"_carried_{k}") for k, name in enumerate(carry)]
    rows = df.select(F.col(id_col).alias("_id"), (normalize(text) if normalize else text).cast("binary").alias("_bytes"), *moved)
    rows = rows.withColumns({"_hash": F.xxhash64("_bytes"), "_head": F.substring("_bytes", 1, SPLITTER_BYTES)})
    first = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()

    def runs(some: DataFrame, *salt: str) -> DataFrame:
        # The range partitioning serves the window, so texts move once. It sorts by whole
        # texts within a range; rows belong together where neighbours' bytes are equal.
        ranged = some.withColumn("_deal", F.pmod("_hash", F.lit(2 * parts)).cast("int")).repartitionByRange(parts, "_head", "_deal", *salt)
        run = Window.partitionBy("_head", "_deal", *salt, "_bytes").orderBy(first)
        all_of_it = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ranged.withColumns({"_nth": F.row_number().over(run), "keep_id": F.first("_id").over(all_of_it), "group_size": F.count(F.lit(1)).over(all_of_it)})

    def result(some: DataFrame, stays: Column) -> DataFrame:
        given = [F.when(~F.col(f"_carried_{k}"), F.col("_bytes").cast("string")).alias(name) if k in whole else F.col(f"_carried_{k}").alias(name) for k, name in enumerate(carry)]
        return some.select(
            F.col("_id").alias(id_col), *given, "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            stays.alias("stays"), F.lower(F.sha2("_bytes", 256)).alias("text_sha256"), F.length("_bytes").cast("long").alias("n_bytes"),
        )

    large = large_texts(rows, parts)
    if large.isEmpty():
        return result(runs(rows), F.col("_nth") == 1)
    # Of bounded size: see large_texts.
    dealt = rows.join(F.broadcast(large), F.col("_hash") == F.col("_large"), "left").drop("_large")
    light = result(runs(dealt.where("_slots is null").drop("_slots")), F.col("_nth") == 1)
    salted = cut(runs(dealt.where("_slots is not null").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_slots")).cast("int")).drop("_slots"), "_salt"))
    # One row for each text and slot, compared in full; each has its slot's best id.
    same = Window.partitionBy("_hash", "_bytes").orderBy(first, "_salt")
    all_of_them = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = salted.where("_nth = 1").select(
        F.col("_hash").alias("_hash2"), F.col("_salt").alias("_salt2"), F.col("_bytes").alias("_bytes2"), F.row_number().over(same).alias("_nth2"),
        F.first("_id").over(all_of_them).alias("_keep2"), F.sum("group_size").over(all_of_them).alias("_size2"),
    )
    met = (F.col("_hash") == F.col("_hash2")) & (F.col("_salt") == F.col("_salt2")) & (F.col("_bytes") == F.col("_bytes2"))
    heavy = salted.join(cut(firsts).hint("merge"), met).withColumns({"keep_id": F.col("_keep2"), "group_size": F.col("_size2")})
    return light.union(result(heavy, (F.col("_nth") == 1) & (F.col("_nth2") == 1)))
