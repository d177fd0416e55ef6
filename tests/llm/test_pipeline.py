import random

import corpus_pipeline
from gleanery.llm import packing, quality_rules, substring_dedup
from gleanery.llm.queries import WORD_MODEL, vocabulary


def sentence_text(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


def similarity(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(14)
    texts = [sentence_text(rng, rng.randint(150, 400)) for _ in range(25)]
    shared = sentence_text(rng, 84)
    texts[3] += "\n" + shared
    texts[7] += "\n" + shared
    texts += [texts[0], texts[1], texts[2].replace(texts[2].split()[40], "changed")]
    texts += ["spam spam spam spam spam spam spam spam", "HOME | ABOUT | NEWS | MORE\n" * 30, "too short.", None, "", texts[4] + "\n@@@ | ### | $$$ | ***"]
    folder = str(tmp_path)
    rows = [(100 - k, text, "en", "src0", len(text or "")) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")

    made, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        made.append({r["doc_id"]: r for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    want = {}
    for doc, text, *_ in rows:
        found = quality_rules.judge(text)
        if found[6]:
            want[doc] = found[-1]
    check = lambda k: {d: r["text"] for d, r in made[k].items()} == want and all(r["n_chars"] == len(r["text"]) for r in made[k].values())
    assert check(0) and len(want) == 29

    first = {}
    for doc in sorted(want):
        first.setdefault(want[doc], doc)
    want = {doc: text for text, doc in first.items()}
    assert check(1) and len(want) == 26

    kept = {}
    for doc in sorted(want):  # only the planted copy is near any other text
        if not any(similarity(want[doc], text) >= 0.8 for text in kept.values()):
            kept[doc] = want[doc]
    want = kept
    assert check(2) and len(want) == 25

    chunking, table, seen, clean = substring_dedup.Chunking(), substring_dedup.gear_table(), {}, {}
    beside = lambda after, pos, source, place: want[source].encode()[place:][:160] if after else want[source].encode()[:place][-160:]
    for doc in sorted(want):
        data, repeats, at = want[doc].encode(), [], 0
        for end in substring_dedup.chunk_ends(data, chunking, table):
            if data[at:end] in seen:
                repeats.append((at, end, *seen[data[at:end]]))
            else:
                seen[data[at:end]] = doc, at
            at = end
        parts, last = [], 0
        for begin, end, _ in substring_dedup.passages(data, repeats, beside, 80):
            begin, end = substring_dedup.whole_words(data, begin, end)
            parts, last = [*parts, data[last:begin]], end
        clean[doc] = b"".join([*parts, data[last:]]).decode()
    assert sum(clean[doc] != want[doc] for doc in want) == 1
    want = clean
    assert check(3)

    tokens = packing.WordTokenizer(vocabulary(WORD_MODEL)).engine
    lengths = {doc: len(tokens.encode(text, add_special_tokens=False).ids) + 1 for doc, text in want.items()}
    packed = {}
    for r in made[4]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        assert r["offset"] + r["length"] <= 4096
    assert packed == lengths
    assert corpus_pipeline.run(spark, folder).count() == len(made[4])


def test_stages_take_odd_rows(spark):
    """Null and repeated ids, equal rows, clashing columns and no rows."""
    rng = random.Random(15)
    one, two = sentence_text(rng, 60), sentence_text(rng, 60)
    rows = [(1, one), (1, one), (1, two), (None, one), (None, two + " More of it."), (2, None), (None, None), (3, ""), (4, two.replace(two.split()[30], "other"))]
    docs = spark.createDataFrame([(*r, 1, "x", True, 2.0, "y", "z") for r in rows], "doc_id long, text string, n_chars long, kept string, stays boolean, keep_id double, clean_text string, node string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0
        docs = stage(spark, docs, "")
        if "text" in docs.columns:
            assert docs.columns == ["doc_id", "text", "n_chars", "kept", "stays", "keep_id", "clean_text", "node"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.collect()} == {1}


def test_exact_stage_keeps_unique_texts_without_an_id(spark):
    rows = [(1, "a"), (2, "a"), (None, "a"), (None, "only here"), (None, None), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.exact(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (None, "only here"), (None, None), (3, "b")], key=str)
