"""Evaluation runs: rank all cases in one batch, score them, and write the run as JSON."""

from __future__ import annotations

import argparse
import importlib
import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import evaluation as e
from gleanery.settings import Settings
from gleanery.sources.files import read_evaluation_cases

#: Takes (spark, queries by case id) and returns hits with query_id, chunk_id, document_id and rank.
Retriever = Callable[[SparkSession, dict], DataFrame]


def evaluate(cases: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics of each case, and their averages."""
    per_case = e.metrics(e.rankings_of(hits, cases), e.relevant_items(cases), cases)
    return per_case, e.averages(per_case)


def run_evaluation(spark: SparkSession, path: str, retrieve: Retriever, settings: Settings = Settings(), output: str | None = None, embedding_version: str | None = None, reranker_version: str | None = None) -> dict:
    """Scores a data set. Cases are curated by hand, so that their queries fit the driver."""
    cases = read_evaluation_cases(spark, path)
    queries = {row["case_id"]: row["query"] for row in cases.select("case_id", "query").collect()}
    started = datetime.now(UTC)
    per_case, means = evaluate(cases, retrieve(spark, queries))
    run = {
        "run_id": uuid.uuid4().hex,
        "dataset_path": path,
        "started_at": started.isoformat(),
        "finished_at": datetime.now(UTC).isoformat(),
        "settings": {name: str(value) if name.endswith(("_dir", "_root")) else value for name, value in vars(settings).items()},
        "embedding_model_version": embedding_version,
        "reranker_model_version": reranker_version,
        "cases": [row.asDict() for row in per_case.orderBy("case_id").collect()],
        "averages": means.first().asDict(),
    }
    if output:
        write_json(spark, run, output)
    return run


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """Pretty JSON in UTF-8, at any path that Spark writes; folders are made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True).encode()))
    out.close()


def load_retriever(name: str) -> Retriever:
    """A retriever by its ``module:function`` name."""
    module, _, function = name.partition(":")
    found = getattr(importlib.import_module(module), function, None) if function else None
    if not callable(found):
        raise ValueError(f"no such retriever: {name}")
    return found


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Score a retriever on an evaluation data set.")
    parser.add_argument("dataset")
    parser.add_argument("retriever", help="module:function")
    parser.add_argument("--output")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gleanery-evaluation").getOrCreate()
    run = run_evaluation(spark, args.dataset, load_retriever(args.retriever), Settings.from_environment(), args.output)
    print(json.dumps(run["averages"], sort_keys=True))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
