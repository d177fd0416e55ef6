"""Connected components of an undirected graph, by contraction in tasks and alternating stars."""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut
from gleanery.shipping import ship_package

#: Edges that a task contracts at a time, about.
TASK_EDGES = 200_000


def _cut(df: DataFrame) -> DataFrame:
    """``cut`` that forgets the estimated size as well: joins multiply it, so that each round would double its digits."""
    done, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """In each of some tasks, the edges' components as stars (a, b) around their smallest nodes."""
    ship_package(edges.sparkSession)

    def run(batches):
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in parent if parent[x] != x]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column in zip(*stars)], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """For each node of ``edges`` (columns a, b) that isn't a root: node, root (the component's smallest node).

    Each round first contracts the edges that a task holds, of about ``TASK_EDGES``, to
    stars; if one task held all, that is the result. Otherwise it hangs every node's
    larger neighbours, then its smaller ones, on its smallest neighbour, until all edges
    lead to roots; rounds follow the logarithm of the longest path. Neighbour sets are
    never gathered: a minimum is aggregated for each node and joined back, with the
    minima written first, so that a hub's edges can be split.
    """
    edges = _cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        tasks = max(1, ceil(edges.count() / TASK_EDGES))
        edges = _cut(_contracted(edges, tasks))
        if tasks == 1 or _stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").count() == 0
