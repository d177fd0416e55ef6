import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import components, exact_dedup, html_extraction, language_id, licenses, packing, quality_rules, sentencepiece_codec, simhash, substring_dedup, url_filter
from gleanery.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, _id int, kept string, sequence_id long"


def docs(spark, *texts):
    """Rows with null columns and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, text, None, None, None, "x", None) for k, text in enumerate(texts)], SCHEMA)


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_exact_dedup(spark):
    rows = docs(spark, "a", "b", "a", None, "", "c" * 50_000, "a ", "b", "c" * 50_000)
    for keep, pick in (("smallest", min), ("largest", max)):
        groups = defaultdict(list)
        for r in rows.collect():
            groups[r["text"] or ""].append(r["doc_id"])
        want = {k: (pick(ids), len(ids), k == pick(ids)) for ids in groups.values() for k in ids}
        found = exact_dedup.dedup_exact(rows, keep=keep).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in found} == want
    assert exact_dedup.dedup_exact(rows.limit(0)).count() == 0
    assert exact_dedup.dedup_exact(docs(spark, "A", "a"), normalize=F.lower).where("kept").count() == 1
    with pytest.raises(ValueError):
        exact_dedup.dedup_exact(rows, keep="any")


def test_exact_dedup_of_large_texts_and_heads(spark):
    """Texts that fill ranges are dealt over several, and texts with one long beginning are told apart."""
    rng = random.Random(20)
    head = "The same beginning of sixty-four bytes, or a little more than that, stands here. "
    texts = ["hot"] * 400 + ["warm" * 30] * 150 + [head + str(rng.randint(0, 80)) for _ in range(400)] + [head] * 60
    rng.shuffle(texts)
    rows = docs(spark, *texts).withColumn("doc_id", F.when(F.col("doc_id") % 50 != 7, F.col("doc_id"))).withColumnRenamed("kept", "_salt")
    kept_width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert exact_dedup.large_texts(rows.select(F.xxhash64(F.col("text").cast("binary")).alias("_hash")), 16).count() >= 2
        found = exact_dedup.dedup_exact(rows, keep="largest", carry=["text", "_salt"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept_width)
    groups = defaultdict(list)
    for k, text in enumerate(texts):
        groups[text].append(None if k % 50 == 7 else k)
    got = Counter((r["text"], r["doc_id"], r["keep_id"], r["group_size"]) for r in found)
    want = Counter((text, k, max((x for x in ids if x is not None), default=None), len(ids)) for text, ids in groups.items() for k in ids)
    assert got == want
    assert Counter(r["text"] for r in found if r["stays"]) == dict.fromkeys(groups, 1)


def test_substrings_without_white_space_and_with_odd_ids(spark):
    rng = random.Random(21)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(500))
    own = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(80)) for _ in range(3)]
    one, two = passage(rng, 120), passage(rng, 120)
    rows = [(1, own[0] + chinese), (2, own[1] + chinese), (3, chinese + own[2]), (5, one), (5, two), (6, passage(rng, 40)), (None, one), (None, "only " + two[:20]), (7, two + " " + two)]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["removed_bytes"] > 0): r for r in found}
    size = len(chinese.encode())
    assert found and by[2, True]["removed_bytes"] > 0.9 * size and by[3, True]["removed_bytes"] > 0.9 * size and (1, False) in by
    assert sorted(r["clean_text"] for r in found if r["doc_id"] == 5) == sorted([one, two])
    assert [r["removed_bytes"] > 0.8 * len(one) for r in found if r["doc_id"] is None] in ([True, False], [False, True])
    assert by[7, True]["removed_bytes"] > 1.5 * len(two)


def edited(rng, words, share, blocks=1):
    """The words with blocks of others in place of ``share`` of them."""
    words, size = list(words), max(1, round(len(words) * share / blocks))
    for b in range(blocks):
        at = rng.randrange(len(words) * b // blocks, max(len(words) * b // blocks + 1, len(words) * (b + 1) // blocks - size))
        words[at : at + size] = [f"new{rng.randrange(10**9)}" for _ in range(size)]
    return words


@pytest.mark.parametrize("length", [100, 400, 2000])
def test_near_copies_with_edited_blocks_are_found(spark, length):
    rng = random.Random(length)
    texts, pairs = [], []
    for k in range(60):
        base = [f"{k}x{j}" for j in range(length)]
        while True:
            copy = edited(rng, base, rng.uniform(0.02, 0.11), rng.choice([1, 1, 2, 4]))
            one, two = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, copy))
            if len(one & two) >= 0.8 * len(one | two):
                break
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(copy)]
    found = {r["doc_id"]: r["group_id"] for r in simhash.verified_groups(docs(spark, *texts)).collect()}
    assert sum(found.get(b) == a for a, b in pairs) >= 0.98 * len(pairs) and set(found) <= {b for _, b in pairs}


def test_odd_rows_and_empty_tables(spark):
    """Null ids, repeated ids, null and very long texts, equal rows; and no rows at all."""
    rng = random.Random(22)
    long = " ".join(f"{passage(rng, 9).capitalize()}." for _ in range(4000))
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words here"), (None, "a b c"), (None, None), (2, None), (3, ""), (4, long), (5, long + " tail"), (None, long)]
    odd = spark.createDataFrame([(*r, "en", "s", "x", 1, "y", 2, 3.0) for r in rows], "doc_id long, text string, lang string, source string, id string, node int, fp string, root int, shingles double")
    empty = odd.where("false")
    word, piece = vocabulary(WORD_MODEL), vocabulary(PIECE_MODEL)
    pages = lambda df: df.withColumnsRenamed({"doc_id": "page_id", "text": "html"})
    urls = lambda df: df.withColumnsRenamed({"doc_id": "page_id", "text": "url"})
    files = lambda df: df.withColumn("path", F.concat_ws("/", "source", "doc_id"))
    made = {
        "html": lambda df: html_extraction.extract_pages(pages(df), carry=["source", "id"]),
        "exact": lambda df: exact_dedup.dedup_exact(df, carry=["text", "id"]),
        "substrings": lambda df: substring_dedup.dedup_substrings(df, carry=["id", "node"]),
        "rules": lambda df: quality_rules.quality_rules(df, carry=["id"]),
        "urls": lambda df: url_filter.filter_urls(urls(df), [url_filter.Rule("block", "net", "/")]),
        "licenses": lambda df: licenses.scan_licenses(files(df), id_col="doc_id"),
        "pieces": lambda df: sentencepiece_codec.digests(sentencepiece_codec.encode_documents(df, piece)),
        "languages": lambda df: language_id.identify(df, language_id.train(df, F.lit(True)), carry=["id"]),
        "simhash": simhash.near_duplicates,
    }
    for name, run in made.items():
        assert run(odd).count() == len(rows), name
        assert run(empty).count() == 0, name
    packed = packing.pack(packing.cut_pieces(odd, word)).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in packed} >= {(None, 1), (2, 1), (3, 1)} and packing.pack(packing.cut_pieces(empty, word)).count() == 0
    near = Counter((r["doc_id"], r["group_id"]) for r in simhash.verified_groups(odd).collect())
    assert near == Counter({(None, 1): 1, (None, 2): 1, (3, 2): 1, (5, 4): 1, (None, 4): 1}) and simhash.verified_groups(empty).count() == 0


def test_a_language_of_overlong_documents_is_learned(spark):
    rows = [(k, "schön und gut " * 30, "de") for k in range(6)] + [(10 + k, "the quick fox " * 40, "en") for k in range(6)] + [(30, "ça va bien " * 300, "fr"), (30, "ça va bien " * 300, "fr")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_rows(docs_, F.lit(True), 400, "doc_id", "text", "lang")
    assert sample.count() == len(rows)
    model = language_id.train(docs_, F.lit(True), characters_at_most=2000)
    assert model.languages == ["de", "en", "fr"] and model.predict("ça va")[0] == "fr"


def test_whole_licence_texts(spark):
    texts = dict(licenses.WHOLE_TEXTS)
    lines = lambda text: "\n".join(text[k : k + 70] for k in range(0, len(text), 70))
    rows = [(k, f"p{k}/LICENSE", text.replace("Copyright (c)", "\n\nCopyright (c) 2020 A. Person\n\n")) for k, text in enumerate(texts.values())]
    rows += [(100, "q/x.py", "def f():\n    return 1\n" * 40 + "\n\n" + lines("no licence words at all " * 9))]
    found = {r["file_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert found == {**dict(enumerate(texts)), 100: None}


def test_license_matches_by_brute_force(spark):
    """Every passage of every text against every template, with plain counters and no filter before."""
    rng = random.Random(23)
    notices = [text for _, text in licenses.TEMPLATES]
    texts = []
    for k in range(60):
        words_ = rng.choice(notices).split()
        for _ in range(rng.randint(0, 3)):
            words_[rng.randrange(len(words_))] = rng.choice(["word", "the", "of"])
        texts.append(passage(rng, 30) + ("\n" + " ".join(words_) + "\n" if k % 3 else "\n") + passage(rng, 20))
    found = {r["file_id"]: (r["license"], r["similarity"]) for r in licenses.scan_licenses(spark.createDataFrame([(k, f"d{k}/f", x) for k, x in enumerate(texts)], "file_id long, path string, text string")).collect()}
    vocabulary_ = {t for _, text in licenses.TEMPLATES + licenses.WHOLE_TEXTS for t in licenses.terms(text)}
    vectors = licenses.Vectors(len(texts), Counter(t for x in texts for t in set(licenses.terms(x)) & vocabulary_))
    for k, text in enumerate(texts):
        best = (0.0, "")
        for line in [*text.split("\n"), text]:
            own = {t: n * vectors.idf.get(t, vectors.rare) for t, n in Counter(licenses.terms(line)).items()}
            length = sum(x * x for x in own.values()) ** 0.5
            for name, weights in zip(vectors.names, vectors.weights):
                if length:
                    best = max(best, (round(sum(x * weights.get(t, 0.0) for t, x in own.items()) / length, 6), name))
        want = (best[1], best[0]) if best[0] >= 0.8 else (None, None)
        assert found[k][0] == want[0] and (want[1] is None or abs(found[k][1] - want[1]) < 2e-6), text


def test_substring_dedup_by_brute_force(spark):
    rng = random.Random(6)
    shared = passage(rng, 70)
    texts = [passage(rng, 80) for _ in range(12)]
    for k in (2, 5, 9):
        texts[k] = f"{texts[k]}\n{shared} {passage(rng, 30)}"
    texts += [texts[0], None, "", "éàü " * 3000]
    rows = docs(spark, *texts)
    found = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(rows, carry=["source"]).collect()}
    chunking, table, seen = substring_dedup.Chunking(), substring_dedup.gear_table(), {}
    beside = lambda after, pos, source, place: ((texts[source] or "").encode()[place:][:160] if after else (texts[source] or "").encode()[:place][-160:])
    for k, text in enumerate(texts):
        data, repeats, at = (text or "").encode(), [], 0
        for end in substring_dedup.chunk_ends(data, chunking, table):
            if data[at:end] in seen:
                repeats.append((at, end, *seen[data[at:end]]))
            else:
                seen[data[at:end]] = k, at
            at = end
        kept, last = [], 0
        for begin, end, _ in substring_dedup.passages(data, repeats, beside, 80):
            begin, end = substring_dedup.whole_words(data, begin, end)
            if begin < end:
                kept, last = [*kept, data[last:begin]], end
        assert found[k]["clean_text"].encode() == b"".join([*kept, data[last:]])
    assert found[2]["removed_bytes"] == 0 and found[5]["removed_bytes"] > 200 and found[9]["runs"][0]["source_id"] == 2
    assert found[12]["clean_text"].strip() == "" and found[0]["removed_bytes"] == 0
    assert all(found[k]["clean_text"] == texts[k] for k in (0, 1, 2, 3, 4, 6, 7, 8, 10, 11))
    assert substring_dedup.dedup_substrings(rows.limit(0)).count() == 0


def test_substrings_reach_the_ends_of_passages(spark):
    """The share of a shared passage's bytes that goes, counted without the operator's code; all that goes stands in its source."""
    rng, rows, shared, pairs = random.Random(11), [], {}, 60
    for size in (25, 35, 50, 100, 200):
        for _ in range(pairs):
            text = passage(rng, size)
            for _ in range(2):
                shared[len(rows)] = size, text
                rows.append((len(rows), f"{passage(rng, 40 + rng.randint(0, 30))} {text} {passage(rng, 40)}"))
    found = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone, whole = Counter(), Counter()
    for k, (size, text) in shared.items():
        data = rows[k][1].encode()
        for run in found[k]["runs"]:
            assert run["source_id"] < k and data[run["begin"] : run["end"]] in rows[run["source_id"]][1].encode()
        if k % 2:
            gone[size] += found[k]["removed_bytes"]
            whole[size] += len(text.encode())
            assert found[k]["removed_bytes"] <= len(text.encode()) + 2
        else:
            assert found[k]["removed_bytes"] == 0
    shares = {size: gone[size] / whole[size] for size in whole}
    assert shares[25] > 0.5 and shares[35] > 0.8 and min(shares[size] for size in (50, 100, 200)) > 0.95, shares


def test_substrings_of_periodic_texts_and_shared_ids(spark):
    """Something of each repeated passage stays, whatever overlaps."""
    rng = random.Random(12)
    unit = passage(rng, 30)
    rows = [(1, " ".join([unit] * 20)), (2, "x " + " ".join([unit] * 5)), (3, unit[7:] + " " + passage(rng, 60)), (4, "abc " * 900), (4, "abc " * 700 + unit), (None, unit + " " + unit), (None, None)]
    found = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r["doc_id"]: r["clean_text"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(found) == len(rows) and unit in kept[1] and unit not in kept[2] and len(kept[3]) < len(rows[2][1]) - len(unit) / 2
    assert all("abc abc" in r["clean_text"] for r in found if r["doc_id"] == 4)
    unit = passage(rng, 60)
    alone = substring_dedup.dedup_substrings(spark.createDataFrame([(None, unit + " " + unit)], "doc_id long, text string")).collect()[0]
    assert unit in alone["clean_text"] and 0 < alone["removed_bytes"] <= len(unit) + 1


def test_chunks_resist_insertions():
    rng, table, chunking = random.Random(7), substring_dedup.gear_table(), substring_dedup.Chunking()
    data = passage(rng, 3000).encode()
    for text in (data, b"", b"x", b"a" * 5000):
        ends = substring_dedup.chunk_ends(text, chunking, table)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(text) and all(chunking.least <= n <= chunking.most for n in sizes[:-1])

    for text in (data[:4000], "的一是不了人我在有他这".encode() * 30, b"ab" * 700):
        ends, last = [], 0
        for k in range(1, len(text) + 1):
            rolling = sum(int(table[text[k - 1 - age]]) << age for age in range(min(k, 32))) & 0xFFFFFFFF
            if k - last == chunking.most or (k - last >= chunking.least and rolling >> (32 - chunking.bits) == 0) or k == len(text):
                ends.append(k)
                last = k
        assert substring_dedup.chunk_ends(text, chunking, table) == ends

    def cut(d):
        ends = substring_dedup.chunk_ends(d, chunking, table)
        return {d[a:b] for a, b in zip([0, *ends], ends)}

    assert len(cut(data) & cut(b"inserted" + data)) >= 0.98 * len(cut(data))
    hashes = substring_dedup.gear_hashes(np.frombuffer(data, np.uint8), table)
    for k in (0, 5, 31, 32, 1000):
        want = sum(int(table[data[k - age]]) << age for age in range(min(k + 1, 32))) & 0xFFFFFFFF
        assert int(hashes[k]) == want


def test_packing(spark):
    rng = random.Random(8)
    texts = [passage(rng, rng.randint(1, 40)) for _ in range(60)] + ["a b c"] * 30 + [None, "", passage(rng, 500)]
    rows = docs(spark, *texts)
    found = packing.pack(packing.cut_pieces(rows, vocabulary(WORD_MODEL), window=64, with_ids=True), 64).collect()
    tokens = packing.WordTokenizer(vocabulary(WORD_MODEL)).engine
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for k, text in enumerate(texts):
        want = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[k], key=lambda r: r["start"])
        assert [x for r in pieces for x in r["ids"]] == want and {r["doc_tokens"] for r in pieces} == {len(want)}
        assert [r["start"] for r in pieces] == list(np.cumsum([0] + [r["length"] for r in pieces])[:-1])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding <= 128
    assert packing.pack(packing.cut_pieces(rows.limit(0), vocabulary(WORD_MODEL))).count() == 0


def test_map_operators_take_any_rows(spark):
    rows = docs(spark, "One good line is here, and it ends well.", None, "", "x" * 200_000)
    rules = quality_rules.quality_rules(rows, carry=["source", "kept"])
    assert rules.count() == 4 and rules.columns[:3] == ["doc_id", "source", "kept"]
    encoded = sentencepiece_codec.digests(sentencepiece_codec.encode_documents(rows, vocabulary(PIECE_MODEL)))
    assert {r["doc_id"]: r["n_tokens"] for r in encoded.collect()}[1] == 0
    pages = html_extraction.extract_pages(rows.withColumnRenamed("text", "html").withColumnRenamed("doc_id", "page_id"), carry=["source"])
    assert pages.count() == 4
    model = language_id.train(rows.withColumn("lang", F.lit("en")), F.lit(True))
    assert [r["lang_pred"] for r in language_id.identify(rows, model).orderBy("doc_id").collect()] == ["en", "und", "und", "en"]
    assert encoded.where("not spans_cover").count() == 0 and {r["doc_id"]: r["span_bytes"] for r in encoded.collect()}[3] == 200_000


def test_url_filter_by_brute_force(spark):
    rng = random.Random(9)
    rules = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
    hosts, paths = ["net", "example.net", "a.example.net", "xexample.net", "EXAMPLE.com", "b.example.com:80", "w.org", "org", ""], ["", "/", "/en/", "/en", "/english/x", "/de/1?a=/en/", "/fr/#/de/", "?q", "#/en/"]
    urls = [f"{s}{rng.choice(hosts)}{rng.choice(paths)}" for s in ("http://", "https://", "", "x://") for _ in range(60)] + [None, "", "no scheme", "a://b://c/en/"]
    rows = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    as_table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules] * 2, "verdict string, host string, path string")
    for bits, given in ((url_filter.CONSTANT_BITS, rules), (3, as_table)):  # the second lies in tables
        found = {r["page_id"]: r for r in url_filter.filter_urls(rows, given, constant_bits=bits).collect()}
        for k, url in enumerate(urls):
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            whole = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
            host, _, _ = rest[:whole].partition("/")
            path = rest[len(host) : whole]
            host = host.lower()
            fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            best = max(fits, key=lambda r: len(r.key), default=None)
            assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, best and best.key, best.verdict if best else "allow")
    assert url_filter.filter_urls(rows.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(rows, []).collect()} == {"allow"}


def test_a_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 13 == 0).alias("listed"))
    whole, tables = url_filter.Cascade(keys), url_filter.Cascade(keys, constant_bits=500)
    assert len(whole.levels) > 1 and whole.constant and not tables.constant and all(level.table is not None for level in tables.levels)
    for cascade in (whole, tables):
        marked = cascade.mark(keys, "found")
        assert marked.count() == 4000 and marked.where(F.col("found") != F.col("listed")).count() == 0


def test_rules_are_checked(spark):
    rows = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for bad in ([url_filter.Rule("block", "a/b", "/")], [url_filter.Rule("block", "a", "b")], [url_filter.Rule("block", "a", "/"), url_filter.Rule("allow", "a", "/")]):
        with pytest.raises(ValueError):
            url_filter.filter_urls(rows, bad)


def test_the_licence_query_inherits_from_both_folders(spark, tmp_path):
    from gleanery.llm import queries

    own, plain = "Released under the MIT License.", "some words without any of it"
    rows = [(100, own + " " + "and many other words here " * 20, "a"), (101, plain, "a"), (112, plain, "a"), (113, "Licensed under CC BY 4.0.", "a"), (123, plain, "a"), (201, plain, "a"), (102, plain, "b"), (103, plain, None), (None, own, "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: (r["license"], r["via"], r["license_folder"]) for r in queries.op7_license_scan(spark, str(tmp_path)).collect()}
    nothing = (None, None, None)
    assert found == {
        100: ("MIT", "own", None), 101: ("MIT", "inherited", "a/1"), 112: ("CC-BY-4.0", "inherited", "a/1/11"), 113: ("CC-BY-4.0", "own", None),
        123: ("MIT", "inherited", "a/1"), 201: nothing, 102: nothing, 103: nothing, None: ("MIT", "own", None),
    }


def test_licenses(spark):
    files = [
        (0, "src/LICENSE", "Released under the MIT License."), (1, "src/a/b.py", "# plain code\nx = 1"), (2, "src/a/COPYING", "Licensed under the Apache License, Version 2.0."), (3, "src/a/deep/c.py", "y = 2"),
        (4, "other/d.py", "# Copyright\n# This work is licensed under the GNU General Public License,\n# version 3.\n" + "z = 3\n" * 50), (5, None, None), (6, "other/e.py", ""), (7, "src/f.py", "All rights reserved."), (8, "src/a/g.py", "Some text on licensing fees and permission slips."),
    ]
    rows = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, path string, text string, license string")
    found = {r["file_id"]: (r["license"], r["via"], r["license_folder"]) for r in licenses.scan_licenses(rows).collect()}
    assert found[0] == ("MIT", "own", None) and found[1] == found[8] == ("Apache-2.0", "inherited", "src/a") and found[3] == ("Apache-2.0", "inherited", "src/a")
    assert found[4] == ("GPL-3.0", "own", None) and found[5] == found[6] == (None, None, None) and found[7] == ("Proprietary", "own", None)
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def test_a_language_sample_is_bounded_by_rows(spark):
    """Many texts of one id are ranked each; copies count up to the bound."""
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("words of text number "), F.col("id") % 1500).alias("text"), F.lit("en").alias("lang"))
    sample = lambda df: language_id.training_rows(df, F.lit(True), 100, "doc_id", "text", "lang")
    assert sample(rows).count() == 100 and sample(rows).select("text").distinct().count() >= 50
    assert sample(rows.withColumn("text", F.lit("the same"))).count() == 100


def test_components(spark, monkeypatch):
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rng.shuffle(edges)
    for size in (components.TASK_EDGES, 25):  # the second needs rounds over several tasks
        monkeypatch.setattr(components, "TASK_EDGES", size)
        found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
        assert found == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(spark):
    rng = random.Random(11)
    base = passage(rng, 400).split()
    texts = [passage(rng, rng.randint(0, 60)) for _ in range(80)] + [None, "", "A b", "a B"]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "zz"
        texts.append(" ".join(copy))
    rows = docs(spark, *texts)
    prints = [plain_fingerprint(text) for text in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(rows).collect()}
    assert found == {k: (f"{prints[k]:016x}", find(k)) for k in range(len(texts))}
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(12)
    for n in (10, 10_000, 10_000_000):
        both = np.full((64, 64), n // 4)
        np.fill_diagonal(both, n // 2)
        for radius in (0, 3, 4, 6):
            plan = simhash.allocate(n, both, radius)
            assert sum(t + 1 for _, t in plan) == radius + 1
            assert sum(mask for mask, _ in plan) == np.bitwise_or.reduce(np.array([mask for mask, _ in plan], np.uint64))
            for _ in range(200):
                flip = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
                assert any((flip & mask).bit_count() <= t for mask, t in plan)


def swapped(words, places):
    """The words with those of some places exchanged with the next: the set of words, so its fingerprint, stays."""
    words = list(words)
    for k in places:
        words[k], words[k + 1] = words[k + 1], words[k]
    return words


def test_verified_groups_finds_all_links(spark):
    rng = random.Random(28)
    base = [f"w{k}" for k in range(600)]
    star = [base] + [swapped(base, rng.sample(range(0, 594, 7), 8)) for _ in range(50)]
    chain = [[f"x{k}" for k in range(600)]]
    for _ in range(39):
        chain.append(swapped(chain[-1], rng.sample(range(0, 594, 7), 8)))
    texts = [" ".join(words) for words in star + chain]
    order = list(range(len(texts)))
    rng.shuffle(order)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (texts[k].split() for k in order)]
    group = list(range(len(sets)))
    inside = []
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                inside.append((a, b))
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) == 2 and len(inside) < 140  # few pairs hold the star and the chain together
    found = {r["doc_id"]: r["group_id"] for r in simhash.verified_groups(docs(spark, *(texts[k] for k in order))).collect()}
    assert found == {k: g for k, g in enumerate(group) if k != g}


def test_verified_groups(spark):
    rng = random.Random(13)
    one, two = passage(rng, 300), passage(rng, 300)
    words = one.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = docs(spark, one, two, near, None, "", near + " tail", "short text")
    found = {r["doc_id"]: r["group_id"] for r in simhash.verified_groups(rows).collect()}
    assert {k: v for k, v in found.items() if k != v and k != 4} == {2: 0, 5: 0}
    assert Counter(found.values())[0] in (2, 3)
