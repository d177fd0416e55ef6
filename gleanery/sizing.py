"""Shuffles that fit what passes through them, so that a task's share doesn't grow with the input."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

PARTITIONS = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: Spark deletes a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text of a task, in bytes, and what is read of a shuffle by one, where Spark puts partitions together.
TASK_BYTES, TASK_READ = 32 << 20, "16m"


def partitions_of(spark: SparkSession, size: float, share: float) -> int:
    """Partitions of at most ``share`` each, but no fewer than are set."""
    return max(int(spark.conf.get(PARTITIONS)), int(-(-size // share)))


@contextmanager
def shuffles_for(spark: SparkSession, size: int, cleaned: bool = False) -> Iterator[None]:
    """Shuffles of ``size`` bytes of text have tasks of at most ``TASK_BYTES`` meanwhile; the settings are put back.

    ``cleaned``: each query's files go with it; for work in steps that write what they hand on.
    """
    before = {name: spark.conf.get(name) for name in (PARTITIONS, ADVISORY, CLEANUP)}
    if cleaned:
        spark.conf.set(CLEANUP, "true")
    spark.conf.set(PARTITIONS, str(partitions_of(spark, size, TASK_BYTES)))
    spark.conf.set(ADVISORY, TASK_READ)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
