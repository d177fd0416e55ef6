"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import compress, count, repeat
from operator import is_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.shipping import ship_package

#: Most bytes of input that one Arrow batch hands to a Python worker, unless the session sets another bound.
BATCH_BYTES = 4 << 20
#: Rows, at most, of a table of keys that is sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows an operator gathers before it hands an Arrow batch back.
OUTPUT_ROWS = 2000
#: Characters, at most, of a word that a worker remembers.
LONGEST_REMEMBERED = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. A cluster must set it; on
    one machine, as in tests, a temporary one is used where it is unset. Spark deletes
    what is no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that Spark keeps this application's checkpoints in; see ``cut``."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[[^]]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for written tables, below the folder of the checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_or_merged(df: DataFrame) -> DataFrame:
    """``df``, a written table of keys, with the hint to send it to every task if its size allows that, or else to sort and merge."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    """Shuffle partitions of the session; salts and range partitions follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def map_rows(
    df: DataFrame,
    schema: str | T.StructType,
    start: Callable[[], Callable[..., list]],
    output_rows: int = OUTPUT_ROWS,
) -> DataFrame:
    """Runs ``start()`` once a task, then the function it returns on each row's values.

    The function gets the columns of ``df`` in order and returns a list of output
    tuples. Batches are bounded in bytes on the way in and in rows on the way out,
    so that memory does not follow the partition's size.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                out.extend(one(*row))
                if len(out) >= output_rows:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, struct)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(values), field.type) for values, field in zip(columns, schema)], schema=schema)


class Remembered:
    """What ``learn`` gives for words, kept for the next texts in two generations.

    Once ``limit`` words are kept, they become the older generation, and those
    asked for again move on; the others go at the next turn. So frequent words are
    learned once, and at most four times the limit are kept. Long words, and
    those of a text with more than the limit by itself, aren't kept.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        self.learn, self.limit = learn, limit
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        if len(self.recent) > self.limit:
            self.older, self.recent = self.recent, {}
        found = list(map(self.recent.get, words))
        missing = list(compress(count(), map(is_, found, repeat(None))))
        if missing:
            older = self.older
            asked = {words[k]: None for k in missing}
            new = []
            for word in asked:
                known = asked[word] = older.get(word)
                if known is None:
                    new.append(word)
            if new:
                asked.update(zip(new, self.learn(new)))
            for k in missing:
                found[k] = asked[words[k]]
            if len(asked) <= self.limit:
                long = max(map(len, asked)) > LONGEST_REMEMBERED
                self.recent.update({word: value for word, value in asked.items() if len(word) <= LONGEST_REMEMBERED} if long else asked)
        return found
