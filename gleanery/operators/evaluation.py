"""Retrieval metrics of rankings: recall, reciprocal rank and NDCG, per case and averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.numbers import compensated_sum

CUTOFFS = (5, 10, 20)
METRICS = tuple(f"{name}_at_{k}" for name in ("recall", "ndcg") for k in CUTOFFS) + ("mrr",)


def first_ranks(rankings: DataFrame) -> DataFrame:
    """Rankings (case_id, item_id, rank) with each item once, at its first place, ranked densely."""
    first = rankings.groupBy("case_id", "item_id").agg(F.min("rank").alias("_rank"))
    return first.select("case_id", "item_id", F.row_number().over(Window.partitionBy("case_id").orderBy("_rank", "item_id")).alias("rank"))


def relevant_items(cases: DataFrame) -> DataFrame:
    """case_id and item_id of what is relevant: chunks if a case names any, else documents."""
    chosen = F.when(F.size("relevant_chunk_ids") > 0, F.col("relevant_chunk_ids")).otherwise(F.col("relevant_document_ids"))
    return cases.select("case_id", F.explode(chosen).alias("item_id")).distinct()


def rankings_of(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, document_id, rank) as rankings of the items that the cases judge."""
    by_chunk = cases.select("case_id", (F.size("relevant_chunk_ids") > 0).alias("_chunks"))
    return hits.join(by_chunk, hits["query_id"] == by_chunk["case_id"]).select("case_id", F.when(F.col("_chunks"), F.col("chunk_id")).otherwise(F.col("document_id")).alias("item_id"), "rank")


def gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def metrics(rankings: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """All metrics of each case of ``cases`` (case_id); zeros for a case without relevant items."""
    hits = first_ranks(rankings).join(relevant, ["case_id", "item_id"], "left_semi").where(F.col("rank").isNotNull())
    return scores(hits, relevant.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), cases)


def label_metrics(rankings: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """All metrics of cases (case_id) that are items themselves, where all items of a case's label are relevant.

    ``labels`` (item_id, label) judge the ranked items alone; the others are counted by label, as their pairs with cases would be too many.
    """
    own = cases.join(labels.select(F.col("item_id").alias("case_id"), "label"), "case_id")
    wanted = own.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("case_id", "n")
    hits = first_ranks(rankings).where(F.col("rank").isNotNull()).join(own, "case_id").join(labels, ["item_id", "label"], "left_semi").select("case_id", "rank")
    return scores(hits, wanted, cases)


def scores(hits: DataFrame, wanted: DataFrame, cases: DataFrame) -> DataFrame:
    """All metrics of each case from its relevant hits (case_id, rank) and the number of what is relevant (case_id, n)."""
    # In order of rank and with compensation, so that no sum depends on how rows come.
    within = lambda k: compensated_sum(F.transform(F.filter("ranks", lambda r: r <= k), gain)).alias(f"dcg_{k}")
    counts = [F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in CUTOFFS]
    ranks = F.array_sort(F.collect_list(F.when(F.col("rank") <= max(CUTOFFS), F.col("rank")))).alias("ranks")
    gathered = hits.groupBy("case_id").agg(F.min("rank").alias("first"), ranks, *counts)
    found = gathered.select("*", *map(within, CUTOFFS)).drop("ranks")
    rows = cases.select("case_id").distinct().join(wanted, "case_id", "left").join(found, "case_id", "left")

    def ideal(k: int) -> Column:
        return compensated_sum(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), gain))

    zero = F.lit(0.0)
    recall = [F.coalesce(F.col(f"hits_{k}") / F.col("n"), zero).alias(f"recall_at_{k}") for k in CUTOFFS]
    ndcg = [F.coalesce(F.col(f"dcg_{k}") / F.when(F.col("n") > 0, ideal(k)), zero).alias(f"ndcg_at_{k}") for k in CUTOFFS]
    return rows.select("case_id", *recall, *ndcg, F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"))


def averages(per_case: DataFrame) -> DataFrame:
    """One row: the number of cases and the mean of each metric."""
    return per_case.agg(F.count(F.lit(1)).alias("case_count"), *(F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in METRICS))
