"""Line dedup and hard negatives against brute force."""

import hashlib
import math
import random
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives, line_dedup
from gleanery.llm.common import new_folder
from gleanery.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_chars=20, min_documents=3):
    """{(id, text): (lines, dropped, kept text)}"""
    holders = defaultdict(set)
    for one, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= min_chars:
                holders[key].add((one, text or ""))
    keeper = {key: max((x[0] for x in found if x[0] is not None), default=None) for key, found in holders.items() if len(found) >= min_documents}
    out = {}
    for one, text in rows:
        lines = (text or "").split("\n")
        key = lambda line: line.strip(SPACE).translate(LOWER)
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == one]
        out[one, text or ""] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_corpus(seed):
    rng = random.Random(seed)
    shared = [f"Shared boilerplate line number {k} of the site" for k in range(12)] + ["short", "", "   ", "ÄÖÜ ÄRGER über die große Straße heute"]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.randint(0, 9)):
            line = rng.choice(shared) if rng.random() < 0.5 else f"own words {rng.randint(0, 400)} of a document here"
            lines.append(rng.choice(["", " ", "\t"]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", " \r", "\x0b"]))
        rows.append((k, "\n".join(lines)))
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (None, shared[0] + "\n" + shared[1]), (None, None), (7, rows[7][1]), (9, shared[3]), (5000, "\n".join([shared[4]] * 500))]


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_like_brute_force(spark, batches):
    rows = line_corpus(batches)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "keep_id": F.lit(1), "_at": F.lit(None)})
    found = line_dedup.dedup_lines(df, batches=batches)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "clean_text"]
    want = brute_lines(rows)
    key = lambda x: tuple((v is None, v) for v in x)
    expected = sorted(((one, *want[one, text or ""]) for one, text in rows), key=key)
    assert sorted((tuple(row) for row in found.collect()), key=key) == expected


def test_lines_of_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(empty).count() == 0
    nothing = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert sorted(tuple(row)[1:] for row in line_dedup.dedup_lines(nothing).collect()) == [(1, 0, ""), (1, 0, "")]


def test_bounds_of_length_and_count(spark):
    rows = [(k, "x" * 19 + "\n" + "y" * 20 + "\n" + "ü" * 20) for k in range(3)] + [(9, "z" * 30), (8, "z" * 30)]
    found = {row["doc_id"]: row["clean_text"] for row in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: "x" * 19, 1: "x" * 19, 2: rows[2][1], 9: "z" * 30, 8: "z" * 30}


def test_runs_of_growing_input(spark):
    """Batches that come later: levels merge, each run has a line once, settled lines aren't counted again."""
    runs = line_dedup.LineRuns(spark, new_folder(spark, "runs"), min_documents=2)
    line = "the same line in every document"
    for batch in range(5):
        rows = [(10 * batch + k, f"{line}\nthe own line of {10 * batch + k} and no other") for k in range(2)]
        runs.add(line_dedup.line_rows(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    (only,) = runs.frequent().collect()
    assert only["keep_id"] == 1  # settled in the first batch
    assert sum(run.where(F.col("_h1") == only["_h1"]).count() for run in runs.runs()) == 1
    assert all(run.count() == run.select("_h1", "_h2").distinct().count() for run in runs.runs())
    assert not spark.catalog.listTables()


def test_line_query_digests(spark, tmp_path):
    rows = line_corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(one, *x[:2], hashlib.sha256(x[2].encode()).hexdigest()) for (one, _), x in brute_lines(rows).items()}
    assert {tuple(row) for row in QUERIES["op11_line_dedup"](spark, str(tmp_path)).collect()} == want


def brute_negatives(rows, anchors, k=5):
    whole = []
    for one, label, vector in rows:
        if one is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in ints) < 2**52:
            whole.append((one, label, tuple(ints)))
    out = []
    for anchor in sorted({x for x in whole if anchors(x[0])}):
        score = lambda v: sum(a * b for a, b in zip(anchor[2], v))  # noqa: B023, E731
        others = [(-score(x[2]), x[0], x[1]) for x in whole if x[0] != anchor[0] and len(x[2]) == len(anchor[2])]
        for s, positive, _ in sorted(x for x in others if x[2] == anchor[1])[:k]:
            fit = sorted(x for x in others if x[2] != anchor[1] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:k]
            out.extend((anchor[0], positive, nth, x[1], -s, -x[0]) for nth, x in enumerate(fit, 1))
    return sorted(out)


def vector_rows(seed, count=400, size=10):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, size)) * 0.4
    rows = []
    for k in range(count):
        label = int(rng.integers(0, 4))
        rows.append((k, label, [float(x) for x in (centers[label] + rng.normal(size=size) * 0.3)]))
    same = rows[3][2]
    rows += [(1000 + k, k % 2, same) for k in range(60)]  # ties
    rows += [(100, 1, rows[100][2])] * 2  # a repeated anchor
    odd = [(None, 1, same), (2000, None, same), (2100, 1, None), (2200, 1, [float("nan")] * size), (2300, 2, [float("inf")] + same[1:]), (2400, 1, [None, *same[1:]]), (2500, 1, []), (2600, 1, [1.5, 2.5]), (2601, 1, [1.5, 2.0]), (2602, 2, [1.4, 2.0]), (2700, 1, [1e300] + same[1:]), (2800, 3, [-x for x in same])]
    return rows + odd


@pytest.mark.parametrize("anchor_values", [10**6, 12])
def test_negatives_like_brute_force(spark, anchor_values):
    rows = vector_rows(anchor_values)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("clash"), "rank": F.lit(1), "codes": F.lit(None)})
    found = hard_negatives.mine(df.repartition(3), F.col("id") % 100 == 0, anchor_values=anchor_values)
    assert sorted(tuple(row) for row in found.collect()) == brute_negatives(rows, lambda one: one % 100 == 0)


def test_negatives_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("id") % 100 == 0).count() == 0


def test_bounds_are_rigorous_and_leave_rows_out():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 10, 6000)
    vectors = np.floor(256 * (rng.normal(size=(10, 64))[labels] * 0.1 + rng.normal(size=(6000, 64)) * 0.1))
    books = hard_negatives.centroids(vectors[:2000])
    codes, left = hard_negatives.encode_block(vectors, books)
    rebuilt = np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], axis=1)
    for a in range(0, 6000, 500):
        bound = sum(np.linalg.norm(vectors[a, 2 * m : 2 * m + 2]) * left[:, m] for m in range(32))
        assert (np.abs(vectors @ vectors[a] - rebuilt @ vectors[a]) <= bound + 1e-3).all()
    ids = np.arange(6000)
    anchors = [(int(a), int(labels[a]), vectors[a].astype("<i4").tobytes()) for a in range(0, 6000, 100)]
    windows = hard_negatives.Windows(anchors, [(k, -np.inf, np.inf) for k in range(len(anchors))], books, 5, True)
    windows.pass_by(ids, labels, vectors, codes, left.astype(float))
    for w, (scores, found) in enumerate(windows.best):
        a = int(windows.ids[w])
        exact = sorted((-int(vectors[a] @ vectors[k]), int(k)) for k in ids if labels[k] == labels[a] and k != a)[:5]
        assert [(-int(s), int(k)) for s, k in zip(scores, found)] == exact
    assert windows.exact < 0.6 * windows.pairs
