"""Trees of nodes: numbers that turn questions about ancestors into comparisons, and the closure.

Nodes are grouped by document; a task walks each document's tree once, in linear
time, and holds one document's nodes at a time, besides a batch. A parent that isn't among the nodes counts as a
node without a parent; nodes on a cycle are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.shipping import ship_package

#: Rows of a batch that a task hands back.
OUTPUT_ROWS = 10_000


def intervals(parents: dict[str, str | None]) -> Iterator[tuple[str, int, int, int, bool]]:
    """(node, first, last, depth, known) of each node: ``first`` counts nodes parents first, and what is below a node is after ``first``, up to ``last``."""
    below: dict[str, list[str]] = {}
    tops: dict[str, None] = {}
    for node, parent in parents.items():
        if parent is None:
            tops[node] = None
        else:
            below.setdefault(parent, []).append(node)
            if parent not in parents:
                tops[parent] = None
    count = 0
    open_: list[tuple[str, int, Iterator[str]]] = []  # (node, first, children that are left)
    for top in tops:
        open_.append((top, count, iter(below.get(top, ()))))
        count += 1
        while open_:
            node, first, left = open_[-1]
            child = next(left, None)
            if child is None:
                open_.pop()
                yield node, first, count - 1, len(open_), node in parents
            else:
                open_.append((child, count, iter(below.get(child, ()))))
                count += 1


def ancestors(parents: dict[str, str | None]) -> Iterator[tuple[str, str, int]]:
    """(node, ancestor, distance) of all strict ancestors."""
    for node, above in parents.items():
        distance, seen = 1, {node}
        while above is not None and above not in seen:
            yield node, above, distance
            seen.add(above)
            above, distance = parents.get(above), distance + 1


def _by_document(nodes: DataFrame, walk: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """``walk`` of each document's nodes, as {node: parent} in order of sequence; rows start with the document's id."""
    ship_package(nodes.sparkSession)
    # Grouped, not dealt and sorted: Spark may drop a repartition by a join's key, and the join may then split documents.
    rows = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "node_id", "parent_id"))).alias("nodes"))
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        def documents():
            for batch in batches:
                column = batch.column(1)
                offsets, own = column.offsets.to_pylist(), [column.values.field(name) for name in ("node_id", "parent_id")]
                for document, first, past in zip(batch.column(0).to_pylist(), offsets, offsets[1:]):
                    yield document, dict(zip(*(values.slice(first, past - first).to_pylist() for values in own)))

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=names)

        out = []
        for document, parents in documents():
            for row in walk(parents):
                out.append((document, *row))
                if len(out) >= OUTPUT_ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema)


def tree_numbers(nodes: DataFrame) -> DataFrame:
    """document_id, node_id, first, last, depth and known (whether it is a node); a is above b if a.first < b.first <= a.last."""
    return _by_document(nodes, intervals, "document_id string, node_id string, first long, last long, depth long, known boolean")


def closure(nodes: DataFrame) -> DataFrame:
    """document_id, node_id, ancestor_id and distance of all strict ancestors."""
    found = _by_document(nodes, ancestors, "document_id string, node_id string, ancestor_id string, distance long")
    return found.withColumn("distance", F.col("distance").cast("int"))
