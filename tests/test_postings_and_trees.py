"""The keyword index, trees, context and sums against brute force."""

import math
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery.functions import numbers
from gleanery.operators import context, postings, retrieval, trees
from gleanery.sources.files import discover

CHUNK = "chunk_id string, document_id string, source_path string, sequence int, section_title string, section_path array<string>, text string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def corpus(seed, count=300):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "c++", "größe", "ö", "a.b", "x_y", "delta-one", "mvcc", "MVCC", "ALPHA,", "(beta)", "epsilon+", "4.0"]
    rows = []
    for k in range(count):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
        rows.append((f"c{k}", f"d{k}", f"{rng.choice('aAbB')}/{k % 7}.txt", k % 3, rng.choice([None, "Alpha part", "beta"]), ["root", rng.choice(words)], text))
    return rows


def brute_scores(rows, terms):
    """{chunk: (score, order)} by the rule: 1 for a term in the text, 2 in the title, 2 in the path."""
    out = {}
    for chunk, _, source, sequence, title, path, text in rows:
        as_json = "[" + ",".join(f'"{x}"' for x in path) + "]"
        fields = ((text or "").lower(), 1), ((title or "").lower(), 2), (as_json.lower(), 2)
        score = sum(points for term in terms for field, points in fields if re.search(rf"(?:^|[^A-Za-z0-9_]){re.escape(term)}(?:[^A-Za-z0-9_]|$)", field))
        if score:
            out[chunk] = (-score, source.lower(), sequence, chunk)
    return out


QUERIES = {"q0": "alpha", "q1": "beta alpha", "q2": "c++", "q3": "größe ö", "q4": "a.b x_y root", "q5": "delta-one mvcc 4.0", "q6": "nothing here", "q7": "the of", "q8": "beta alpha", "q9": "epsilon+ beta gamma alpha mvcc"}


@pytest.mark.parametrize("block", [4, 1024])
def test_an_index_finds_what_a_scan_finds(spark, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)  # small blocks: most are skipped
    rows = corpus(block)
    chunks = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    found = retrieval.keyword_search_table(chunks, asked, 7).collect()
    for name, query in QUERIES.items():
        terms = dict.fromkeys(x for x in query.casefold().split() if x not in ("the", "of"))
        best = sorted(brute_scores(rows, terms).values())[:7]
        assert sorted((x["rank"], x["chunk_id"], x["score"]) for x in found if x["query_id"] == name) == [(k, x[-1], -x[0]) for k, x in enumerate(best, 1)]


def test_many_literal_and_many_equal_queries(spark):
    rows = corpus(3, 60)
    chunks = spark.createDataFrame(rows, CHUNK)
    few = retrieval.keyword_search(chunks, {"a": "beta alpha"}, 3).collect()
    many = retrieval.keyword_search(chunks, {f"q{k}": "beta alpha" if k % 2 else "mvcc" for k in range(201)}, 3)
    assert many.select("query_id").distinct().count() == 201
    assert sorted((x["rank"], x["chunk_id"], x["score"]) for x in many.where("query_id = 'q7'").collect()) == sorted((x["rank"], x["chunk_id"], x["score"]) for x in few)
    equal = spark.range(300_000).select(F.col("id").cast("string").alias("query_id"), F.array(F.lit("alpha"), F.lit("beta")).alias("terms"))
    counts = postings.search(postings.index_of(chunks), equal, 3).groupBy("rank", "chunk_id").count().collect()
    assert sorted((x["rank"], x["chunk_id"]) for x in counts) == sorted((x["rank"], x["chunk_id"]) for x in few) and {x["count"] for x in counts} == {300_000}


def test_batches_and_versions_of_an_index(spark, tmp_path):
    rows = corpus(8, 120)
    index = postings.KeywordIndex(spark, f"{tmp_path}/index")
    assert index.batches() == 0 and retrieval.keyword_search_table(index, spark.createDataFrame([("q", "alpha")], "query_id string, query string")).count() == 0
    index.add(spark.createDataFrame([(*row[:6], "alpha beta mvcc") for row in rows[:50]], CHUNK), 0)
    for batch, part in ((1, rows[:80]), (2, rows[80:]), (2, rows[80:])):  # the first 50 again, with other texts; the last batch twice
        index.add(spark.createDataFrame(part, CHUNK), batch)
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    found = retrieval.keyword_search_table(index, asked, 5).collect()
    for name, query in QUERIES.items():
        best = sorted(brute_scores(rows, [x for x in query.casefold().split() if x not in ("the", "of")]).values())[:5]
        assert sorted((x["rank"], x["chunk_id"], x["score"]) for x in found if x["query_id"] == name) == [(k, x[-1], -x[0]) for k, x in enumerate(best, 1)]


def test_blocks_are_skipped(spark, monkeypatch):
    """Of many chunks that tie, only the first blocks are scored."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(f"c{k:04}", f"d{k}", f"{k:04}.txt", 0, None, ["r"], "alpha beta") for k in range(400)]
    index = postings.index_of(spark.createDataFrame(rows, CHUNK))
    blocks = index.postings().where("piece = 'alpha'")
    assert blocks.count() >= 50
    seen = []
    original = postings.term_blocks
    monkeypatch.setattr(postings, "term_blocks", lambda *args: seen.append(original(*args)) or seen[-1])
    hits = postings.search(index, spark.createDataFrame([("q", ["alpha", "beta"])], "query_id string, terms array<string>"), 5)
    assert [x["chunk_id"] for x in hits.orderBy("rank").collect()] == [f"c{k:04}" for k in range(5)]


def test_chunks_are_searched_without_an_index_as_with_one(spark, monkeypatch):
    """Only the terms that are asked for are gathered; an index of all pieces isn't built, unless terms are too many to be sent."""
    rows = corpus(21, 150) + [("c7", "d7", "a/7.txt", 0, None, None, None), ("c8", "d8", "b/8.txt", 1, "Alpha", ["root"], "alpha")]
    chunks = spark.createDataFrame(rows, CHUNK)  # c8 stands there twice
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    key = lambda found: sorted(tuple(row) for row in found.collect())
    want = key(retrieval.keyword_search_table(postings.index_of(chunks), asked, 9))
    built = []
    original = postings.index_of
    monkeypatch.setattr(postings, "index_of", lambda rows: built.append(1) or original(rows))
    assert key(retrieval.keyword_search_table(chunks, asked, 9)) == want and not built
    monkeypatch.setattr(postings, "FEW", 3)
    assert key(retrieval.keyword_search_table(chunks, asked, 9)) == want and built


def test_held_rows_take_little_memory(monkeypatch):
    """What a task holds of its best rows: numbers of pairs, and each row's keys once; ties are decided by the keys."""
    monkeypatch.setattr(retrieval, "SCORED", 100)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (900, 4)).astype(float)  # many are equal
    vectors[~vectors.any(axis=1)] = 1.0
    asked = rng.normal(size=(40, 4))
    names = [f"n{k % 7}" for k in range(900)]
    nearest, most = retrieval.NearestRows(asked, 5), 0
    for first in range(0, 900, 300):
        part = slice(first, first + 300)
        batch = pa.RecordBatch.from_pydict({"chunk_id": [f"c{k}" for k in range(900)][part], "_order": names[part], "sequence": [k % 3 for k in range(900)][part]})
        nearest.pass_by(batch, vectors[part])
        most = max(most, sum(table.nbytes for table in nearest.keys))
    found = list(nearest.found(64))
    units = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    scores = np.round(units @ (asked / np.sqrt((asked * asked).sum(1))[:, None]).T, 12)
    for query in range(40):
        best = sorted(range(900), key=lambda k: (-scores[k, query], names[k], k % 3, f"c{k}"))[:5]
        assert [name for queries, keys, _ in found for q, name in zip(queries.tolist(), keys.column("chunk_id").to_pylist()) if q == query] == [f"c{k}" for k in best]
    assert most <= 900 * 40 and max(len(queries) for queries, _, _ in found) <= 64


def random_tree(rng, count):
    parents = {}
    for k in range(count):
        parents[f"n{k}"] = None if not k else rng.choice([f"n{rng.randrange(k)}", f"n{k - 1}"])
    return parents


def test_intervals_and_closure():
    rng = random.Random(2)
    for _ in range(40):
        parents = random_tree(rng, rng.randint(1, 40)) | ({"lost": "gone"} if rng.random() < 0.5 else {})
        if rng.random() < 0.3:
            parents |= {"x": "y", "y": "x"}
        above = {(node, ancestor): distance for node, ancestor, distance in trees.ancestors(parents)}
        numbers_ = {node: (first, last, depth) for node, first, last, depth, _ in trees.intervals(parents)}
        assert "x" not in numbers_
        for a, (first, last, depth) in numbers_.items():
            for b, (other, _, deeper) in numbers_.items():
                assert (first < other <= last) == ((b, a) in above)
                if (b, a) in above:
                    assert deeper - depth == above[b, a]


def test_a_join_before_does_not_split_documents(spark):
    # A join that turns into a broadcast while it runs hands on its other side as it was read, not by document.
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    }
    before = {name: spark.conf.get(name) for name in settings if name != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 700, numPartitions=7).selectExpr("cast(id % 100 AS string) AS document_id", "cast(id % 100 AS string) || '/' || (id div 100) AS node_id", "CASE WHEN id >= 100 THEN cast(id % 100 AS string) || '/' || ((id div 100 - 1) div 2) END AS parent_id", "cast(id div 100 AS int) AS sequence")
        wanted = spark.range(0, 50, numPartitions=4).selectExpr("cast(id % 50 AS string) AS document_id").distinct()
        nodes = rows.join(wanted, "document_id", "left_semi")
        assert nodes.count() == 350
        found = trees.tree_numbers(nodes).collect()
        assert sorted(x["node_id"] for x in found) == sorted(f"{d}/{k}" for d in range(50) for k in range(7)) and all(x["known"] for x in found)
        assert trees.closure(nodes).count() == 50 * (2 + 2 * 4)
    finally:
        for name in settings:
            spark.conf.unset(name)
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_deep_tree_is_walked_in_linear_time():
    parents = {f"n{k}": f"n{k - 1}" if k else None for k in range(200_000)}
    assert sum(1 for _ in trees.intervals(parents)) == 200_000


def brute_expand(hits, chunks, parents, most, size):
    """The chunks admitted to each hit (query, chunk, rank), by trying all chunks in order."""
    by_id = {x["chunk_id"]: x for x in chunks}
    up = {}
    for node in parents:
        found, at, distance = {}, parents.get(node), 1
        while at is not None:
            found[at], at, distance = distance, parents.get(at), distance + 1
        up[node] = found
    identity = lambda text: " ".join(text.lower().split())
    out = {}
    for query in {x[0] for x in hits}:
        own = sorted((x for x in hits if x[0] == query), key=lambda x: x[2])
        ids, texts = {x[1] for x in own}, {identity(by_id[x[1]]["text"]) for x in own}
        for _, hit, _ in own:
            h, options = by_id[hit], []
            for c in chunks:
                gap = abs(c["sequence"] - h["sequence"])
                if c["chunk_id"] == hit or c["document_id"] != h["document_id"]:
                    continue
                if c["parent_id"] in up.get(h["parent_id"], {}):
                    options.append((0, up[h["parent_id"]][c["parent_id"]], gap, c["chunk_id"]))
                elif h["parent_id"] in up.get(c["parent_id"], {}):
                    options.append((2, up[c["parent_id"]][h["parent_id"]], gap, c["chunk_id"]))
                elif c["chunk_id"] in (h["previous_chunk_id"], h["next_chunk_id"]) or hit in (c["previous_chunk_id"], c["next_chunk_id"]):
                    options.append((1, gap, c["sequence"], c["chunk_id"]))
            taken, used = [], 0
            for *_, one in sorted(options):
                text = by_id[one]["text"]
                if len(taken) < most and one not in ids and identity(text) and identity(text) not in texts and used + len(text) <= size:
                    taken.append(one)
                    ids.add(one)
                    texts.add(identity(text))
                    used += len(text)
            out[query, hit] = taken
    return out


@pytest.mark.parametrize("most,size", [(2, 40), (3, 12)])
def test_context_like_brute_force(spark, most, size):
    rng = random.Random(most)
    nodes, chunks = [], []
    for d in range(6):
        parents = {f"d{d}{node}": parent and f"d{d}{parent}" for node, parent in random_tree(rng, 14).items()}
        nodes += [(f"d{d}", node, parent, k) for k, (node, parent) in enumerate(parents.items())]
        names = list(parents)
        for k in range(40):
            text = rng.choice(["", "  ", "same text", "Same  TEXT", f"t{rng.randint(0, 15)}", "a long text of many words " * rng.randint(1, 2), f"text {k}"])
            chunks.append({"chunk_id": f"d{d}c{k}", "document_id": f"d{d}", "parent_id": rng.choice(names), "sequence": k, "text": text, "previous_chunk_id": f"d{d}c{k - 1}" if k % 5 else None, "next_chunk_id": f"d{d}c{k + 1}" if k % 5 < 4 else None})
    hits = [(f"q{q}", chunk["chunk_id"], rank) for q in range(8) for rank, chunk in enumerate(rng.sample(chunks, 5), 1)]
    all_parents = {node: parent for _, node, parent, _ in nodes}
    rows = spark.createDataFrame([tuple(x.values()) for x in chunks], "chunk_id string, document_id string, parent_id string, sequence int, text string, previous_chunk_id string, next_chunk_id string")
    found = context.expand(spark.createDataFrame(hits, "query_id string, chunk_id string, rank int"), rows, spark.createDataFrame(nodes, "document_id string, node_id string, parent_id string, sequence int"), most, size).collect()
    assert {(x["query_id"], x["chunk_id"]): [c["chunk_id"] for c in x["context"]] for x in found} == brute_expand(hits, chunks, all_parents, most, size)


def test_few_options_of_a_hit_are_gathered(spark):
    options = spark.range(5000).select(F.lit("q").alias("query_id"), F.lit("h").alias("hit_id"), F.lit(2).alias("priority"), F.lit(1).alias("first"), F.col("id").alias("second"), F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("identity"), F.lit(100).alias("size"))
    firsts = spark.createDataFrame([("q", "h", 1), ("q", "i", 2)], "query_id string, chunk_id string, rank int")
    assert context.admissible(options, firsts, 2, 4000).count() == 2 + 2 + 2


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(4)
    values = [rng.choice([1e16, 1.0, -1e16, 1e-9]) * rng.random() for _ in range(300)]
    rows = spark.createDataFrame([(values,), ([],), ([0.1] * 10,)], "v array<double>")
    found = [x[0] for x in rows.select(numbers.compensated_sum(F.col("v"))).collect()]
    assert math.isclose(found[0], math.fsum(values), rel_tol=1e-12) and found[1] == 0.0 and found[2] == 1.0
    matrix = np.array([rng.sample(values, 300) for _ in range(5)])
    assert np.allclose(numbers.compensated_rows(matrix), math.fsum(values), rtol=1e-12)


def test_nearest_of_a_task_are_its_best(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{k}", "d", f"{'B' if k % 2 else 'a'}{k % 9}.txt", k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(f"t{k}", "d", "tie.txt", k, rows[0][4]) for k in range(300)] + [("n", "d", "n", 0, None), ("z", "d", "z", 0, [0.0] * 8), ("i", "d", "i", 0, [float("nan")] * 8), ("s", "d", "s", 0, [1.0])]
    asked = [(f"q{k}", rows[k][4]) for k in range(0, 300, 30)]
    vectors = spark.createDataFrame(rows, "chunk_id string, document_id string, source_path string, sequence int, vector array<double>").repartition(3)
    found = retrieval.semantic_search(vectors, spark.createDataFrame(asked, "query_id string, vector array<double>"), 6, query_values=30).collect()
    unit = lambda v: [x / math.sqrt(math.fsum(y * y for y in v)) for x in v]
    for name, query in asked:
        scores = []
        for chunk, _, path, sequence, vector in rows:
            if vector and len(vector) == 8 and all(map(math.isfinite, vector)) and any(vector):
                score = max(-1.0, min(1.0, math.fsum(a * b for a, b in zip(unit(query), unit(vector)))))
                scores.append((-round(score, 12), path.lower(), sequence, chunk))
        assert [x["chunk_id"] for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == name] == [x[-1] for x in sorted(scores)[:6]]


def test_files_outside_the_root_are_left_out(spark, tmp_path):
    root, outside = tmp_path / "root", tmp_path / "outside"
    (root / "sub").mkdir(parents=True)
    outside.mkdir()
    (root / "a.txt").write_text("a")
    (root / "sub" / "b.TXT").write_text("b")
    (outside / "t.txt").write_text("secret")
    (root / "link.txt").symlink_to(outside / "t.txt")
    (root / "dlink").symlink_to(outside, target_is_directory=True)
    assert [x["source_path"] for x in discover(spark, str(root)).collect()] == ["a.txt", "sub/b.TXT"]
    alias = tmp_path / "alias"
    alias.symlink_to(root, target_is_directory=True)
    assert [x["source_path"] for x in discover(spark, str(alias)).collect()] == ["a.txt", "sub/b.TXT"]
