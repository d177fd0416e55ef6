"""Context of hits: related chunks of the same document, admitted in order within bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as t
from gleanery.operators.trees import closure, tree_numbers
from gleanery.shipping import ship_package

__all__ = ["closure", "expand", "relations"]


def relations(hits: DataFrame, chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks related to each hit: query_id, hit_id, chunk_id, relation, priority, first, second.

    A chunk of a node above the hit's is a parent; else one of a node below is a
    child; else one linked either way is a neighbour. Trees are numbered, so that both tests compare
    numbers; a chunk that several queries hit is related once.
    """
    linked = ("chunk_id", "document_id", "parent_id", "sequence", "previous_chunk_id", "next_chunk_id")
    wanted = hits.select("query_id", F.col("chunk_id").alias("hit_id")).distinct()
    # Only the hits' documents have related chunks.
    found = wanted.select("hit_id").distinct()
    touched = chunks.select("chunk_id", "document_id").join(found, F.col("chunk_id") == F.col("hit_id")).select("document_id").distinct()
    numbers = tree_numbers(nodes.join(touched, "document_id", "left_semi")).withColumnRenamed("node_id", "parent_id")
    own = chunks.select(*linked).join(touched, "document_id", "left_semi").join(numbers, ["document_id", "parent_id"], "left")
    own = own.select(*linked, F.col("first").alias("_first"), F.col("last").alias("_last"), F.col("depth").alias("_depth"), F.col("known").alias("_known"))
    hit = found.join(own, F.col("hit_id") == F.col("chunk_id")).select("hit_id", *(F.col(name).alias(f"hit_{name}") for name in own.columns if name != "chunk_id"))
    same = F.col("document_id") == F.col("hit_document_id")
    above = (F.col("_first") < F.col("hit__first")) & (F.col("hit__first") <= F.col("_last"))
    below = (F.col("hit__first") < F.col("_first")) & (F.col("_first") <= F.col("hit__last")) & F.col("hit__known")
    gap = F.abs(F.col("sequence") - F.col("hit_sequence"))
    row = lambda frame, relation, priority, first, second: frame.select("hit_id", "chunk_id", relation.alias("relation"), priority.alias("priority"), first.cast("int").alias("first"), second.cast("int").alias("second"))
    in_tree = hit.join(own, same & (above | below)).withColumn("_up", above)
    lines = row(in_tree, F.when(F.col("_up"), "parent").otherwise("child"), F.when(F.col("_up"), 0).otherwise(2), F.abs(F.col("_depth") - F.col("hit__depth")), gap)
    sides = lambda *names: F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("_side")
    forward = hit.select("*", sides("hit_previous_chunk_id", "hit_next_chunk_id")).join(own, F.col("chunk_id") == F.col("_side")).where(same)
    backward = hit.join(own.select("*", sides("previous_chunk_id", "next_chunk_id")), F.col("hit_id") == F.col("_side")).where(same)
    beside = [row(frame, F.lit("neighbor"), F.lit(1), gap, F.col("sequence")) for frame in (forward, backward)]
    everything = lines.unionByName(beside[0]).unionByName(beside[1]).where("chunk_id <> hit_id")
    # Parent before child before neighbour decides the kind; the priority decides the order.
    kind = F.when(F.col("relation") == "parent", 0).when(F.col("relation") == "child", 1).otherwise(2)
    best = everything.groupBy("hit_id", "chunk_id").agg(F.min(F.struct(kind.alias("kind"), "first", "second", "relation", "priority")).alias("b"))
    return wanted.join(best, "hit_id").select("query_id", "hit_id", "chunk_id", "b.relation", "b.priority", "b.first", "b.second")


def admissible(options: DataFrame, firsts: DataFrame, max_chunks: int, max_characters: int) -> DataFrame:
    """``options`` without those that can't be admitted, whatever comes of the others.

    A query with H hits has at most H + (H - 1) * max_chunks chunks and texts that a hit may not take. So once
    ``max_chunks`` more than these come before an option, each of another text and small
    enough that ``max_chunks`` of them fit, and none that is larger came before them, the hit is full
    before the option's turn. With chunks of usual sizes none is larger, and the rows of a hit are bounded.
    """
    hits = firsts.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    order = ("priority", "first", "second", "chunk_id")
    of_text = Window.partitionBy("query_id", "hit_id", "identity").orderBy(*order)
    of_hit = Window.partitionBy("query_id", "hit_id").orderBy(*order)
    fitting = options.where((F.col("identity") != "") & (F.col("size") <= max_characters) & F.lit(max_chunks > 0))
    known = fitting.withColumn("_again", F.row_number().over(of_text)).withColumn("_large", F.count_if(F.col("size") * max_chunks > max_characters).over(of_hit))
    small = F.count_if((F.col("_again") == 1) & (F.col("_large") == 0)).over(of_hit.rowsBetween(Window.unboundedPreceding, -1))
    counted = known.withColumn("_small", small).join(hits, "query_id")
    return counted.where(F.col("_small") < F.col("_hits") + (F.col("_hits") - 1) * max_chunks + max_chunks).drop("_again", "_large", "_small", "_hits")


def expand(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, max_chunks: int = 2, max_characters: int = 4000, identity=t.text_identity) -> DataFrame:
    """Hits with context: an array of (chunk_id, relation, text) admitted for each, in order.

    Within a query, hits come by rank and their related chunks by priority,
    distances and id. A chunk is admitted until the hit has ``max_chunks``, if its
    text fits what is left of ``max_characters`` and neither it nor a chunk of the
    same text is a hit or admitted already. One fold a query, over a bounded number of chunks of each
    of its few hits: see ``admissible``.
    """
    if max_chunks < 0 or max_characters < 0:
        raise ValueError("bounds must not be negative")
    ship_package(hits.sparkSession)
    firsts = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    near = relations(hits, chunks, nodes)
    # The text's normal form is made for hits and their related chunks alone.
    wanted = firsts.select("chunk_id").unionByName(near.select("chunk_id")).distinct()
    texts = chunks.select("chunk_id", "text").join(wanted, "chunk_id", "left_semi").select("chunk_id", "text", identity(F.col("text")).alias("identity"))
    taken = firsts.join(texts, "chunk_id").groupBy("query_id").agg(F.collect_set("chunk_id").alias("ids"), F.collect_set("identity").alias("identities"))
    sized = texts.select("chunk_id", "identity", F.length("text").alias("size"))
    found = admissible(near.join(firsts.withColumnRenamed("chunk_id", "hit_id"), ["query_id", "hit_id"]).join(sized, "chunk_id"), firsts, max_chunks, max_characters)
    option = F.struct("rank", "hit_id", "priority", "first", "second", "chunk_id", "relation", "identity", "size")
    queued = found.groupBy("query_id").agg(F.array_sort(F.collect_list(option)).alias("options")).join(taken, "query_id")
    got = "struct<hit_id:string,chunk_id:string,relation:string>"
    start = F.struct(F.col("ids"), F.col("identities"), F.lit("").alias("hit"), F.lit(0).alias("count"), F.lit(0).alias("used"), F.array().cast(f"array<{got}>").alias("out"))

    def admit(state: Column, x: Column) -> Column:
        fresh = state["hit"] != x["hit_id"]
        count, used = F.when(fresh, 0).otherwise(state["count"]), F.when(fresh, 0).otherwise(state["used"])
        known = F.array_contains(state["ids"], x["chunk_id"]) | F.array_contains(state["identities"], x["identity"])
        fits = (count < max_chunks) & ~known & (x["identity"] != "") & (used + x["size"] <= max_characters)
        one = F.struct(x["hit_id"].alias("hit_id"), x["chunk_id"].alias("chunk_id"), x["relation"].alias("relation"))
        return F.struct(
            F.when(fits, F.concat(state["ids"], F.array(x["chunk_id"]))).otherwise(state["ids"]).alias("ids"),
            F.when(fits, F.concat(state["identities"], F.array(x["identity"]))).otherwise(state["identities"]).alias("identities"),
            x["hit_id"].alias("hit"),
            F.when(fits, count + 1).otherwise(count).alias("count"),
            F.when(fits, used + x["size"]).otherwise(used).alias("used"),
            F.when(fits, F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"),
        )

    admitted = queued.select("query_id", F.posexplode(F.aggregate("options", start, admit, lambda s: s["out"])).alias("_at", "c")).select("query_id", "_at", "c.*")
    texts_of = chunks.select(F.col("chunk_id").alias("_chunk"), "text")
    one = F.transform(F.array_sort(F.collect_list(F.struct("_at", "chunk_id", "relation", "text"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["relation"].alias("relation"), x["text"].alias("text")))
    context = admitted.join(texts_of, F.col("chunk_id") == F.col("_chunk")).groupBy(F.col("query_id").alias("_query"), F.col("hit_id").alias("_hit")).agg(one.alias("context"))
    nothing = F.array().cast("array<struct<chunk_id:string,relation:string,text:string>>")
    return hits.join(context, (F.col("query_id") == F.col("_query")) & (F.col("chunk_id") == F.col("_hit")), "left").select(*hits.columns, F.coalesce("context", nothing).alias("context"))
