"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where the hash's top bits are
zero, within a least and a most size, so that boundaries follow the content and
find each other again after an insertion. Chunks are compared by 128-bit digest.
The first of equal chunks, by document id and place, stays; a later one is a
repeat. A run of neighbouring repeats is extended at both ends, byte by byte, as far
as the bytes around it equal those around the chunk that it repeats, up to the most
bytes of a chunk. A run of at least ``min_run`` bytes is a repeated passage and is
removed, but for the words at its ends that it cuts through; in text without white
space, but for the characters cut through. Each removed byte equals one at a smaller
id or an earlier place, so that something of each passage stays.

Edge cases: a null text counts as empty and stays empty; a text shorter than a
chunk is one chunk; whole texts are chunked, in numpy, in blocks of bounded size;
of equal texts under several ids the smallest id keeps its text; rows of equal ids
don't take passages from each other, but each loses what it has twice or what a
smaller id has, and runs aren't extended by the texts of repeated or null ids; a
row with a null id comes after all others, loses what they have and what it has
twice, and is nobody's source; an empty table gives an empty result; columns other
than those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, map_rows

#: Bytes that a gear hash of 32 bits remembers.
MEMORY = 32
#: Bytes that are hashed at a time.
BLOCK = 1 << 20
#: Bytes in which a word's end is looked for; texts without any there have no words to keep whole.
LONGEST_WORD = 64


def gear_table(seed: int = 42) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Chunking:
    """Chunk sizes in bytes: at least, at most, and 2 ** ``bits`` beyond the least on average."""

    least: int = 24
    most: int = 160
    bits: int = 5
    seed: int = 42


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of table[byte] << age over the last 32 bytes.

    The sum over 2w bytes is that over the last w, plus that over the w before
    shifted by w, so five doublings give it.
    """
    out = np.empty(len(data), np.uint32)
    for at in range(0, len(data), BLOCK):
        lead = min(at, MEMORY)
        hashes = table[data[at - lead : at + BLOCK]]
        width = 1
        while width < MEMORY:
            older = np.zeros_like(hashes)
            older[width:] = hashes[:-width] << np.uint32(width)
            hashes = hashes + older
            width *= 2
        out[at : at + BLOCK] = hashes[lead:]
    return out


def chunk_ends(data: bytes, chunking: Chunking, table: np.ndarray) -> list[int]:
    """Where the chunks of ``data`` end."""
    size = len(data)
    if not size:
        return []
    hashes = gear_hashes(np.frombuffer(data, np.uint8), table)
    marks = (np.flatnonzero(hashes >> np.uint32(32 - chunking.bits) == 0) + 1).tolist()
    ends, last, least, most = [], 0, chunking.least, chunking.most
    for mark in marks:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least:
            last = mark
            ends.append(last)
    while size - last > most:
        last += most
        ends.append(last)
    if last < size:
        ends.append(size)
    return ends


def _text_key(text_col: str):
    """Tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _chunks(df: DataFrame, chunking: Chunking, id_col: str, text_col: str) -> DataFrame:
    """One row a document that isn't empty: id, key (of its text), and for each chunk high, low, end, local (whether an earlier chunk of the document equals it)."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        table, digest = gear_table(chunking.seed), xxhash.xxh3_128_digest

        def one(key, of_text, text):
            data = (text or "").encode()
            ends = chunk_ends(data, chunking, table)
            digests = [digest(data[a:b]) for a, b in zip([0, *ends], ends)]
            longs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            known = set()
            local = [x in known or known.add(x) is not None for x in digests]
            return [(key, of_text, longs[:, 0], longs[:, 1], ends, local)] if ends else []

        return one

    return map_rows(df.select(F.col(id_col), _text_key(text_col), F.col(text_col)), f"id {kind}, key long, high array<long>, low array<long>, end array<int>, local array<boolean>", start)


def repeated_chunks(found: DataFrame) -> DataFrame:
    """Per document with any: id, key and repeats, its chunks that a smaller id or an earlier place has, as (begin, end, source, at: where the source has it)."""
    chunks = found.withColumn("begin", F.concat(F.array(F.lit(0)), F.slice("end", F.lit(1), F.size("end") - 1))).select("id", "key", F.inline(F.arrays_zip("high", "low", "begin", "end", "local")))
    # A digest's rows are summed up before they move. What repeats is written before it is
    # joined, so that the chunks of a passage shared by very many documents can be split.
    first = chunks.groupBy("high", "low").agg(F.min("id").alias("source"), F.min_by("begin", F.when(~F.col("local"), F.col("id"))).alias("at"), F.count(F.lit(1)).alias("n"))
    first = cut(first.where("n > 1").select(F.col("high").alias("h"), F.col("low").alias("l"), "source", "at"))
    same = (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("local") | ~F.col("id").eqNullSafe(F.col("source")))
    again = chunks.join(first.hint("merge"), same)
    return again.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "source", "at"))).alias("repeats"))


def _edges(reach: int) -> Column:
    """The ends of a document's runs that could move: (after, pos, source, place there, gap to the next run or ``reach``)."""
    repeats = F.col("repeats")

    def end(after: bool, pos, x, place, gap):
        return F.struct(F.lit(after).alias("after"), pos.alias("pos"), x["source"].alias("source"), place.alias("place"), F.least(gap, F.lit(reach)).alias("gap"))

    before = F.transform(repeats, lambda x, k: end(False, x["begin"], x, x["at"], x["begin"] - F.coalesce(F.get(repeats, k - 1)["end"], F.lit(0))))
    after = F.transform(repeats, lambda x, k: end(True, x["end"], x, x["at"] + x["end"] - x["begin"], F.coalesce(F.get(repeats, k + 1)["begin"] - x["end"], F.lit(reach))))
    return F.filter(F.concat(before, after), lambda e: e["gap"] > 0)


def _on_row(of: str, key: str) -> Column:
    """Whether a row of ``_id`` and ``_text`` is that of an id and a text's key."""
    return F.col("_id").eqNullSafe(F.col(of)) & (_text_key("_text") == F.col(key))


def surroundings(rows: DataFrame, repeats: DataFrame, ids: DataFrame, reach: int) -> DataFrame:
    """Per document with any: _of, _key and around, the bytes beside the sources of its runs' ends, as (after, pos, bytes).

    ``rows`` has _id and _text first, and all its columns are read, so that its shuffle is that of the caller's own join.
    """
    asks = repeats.select("id", "key", F.inline(_edges(reach))).where(~F.col("id").eqNullSafe(F.col("source")))  # a document's own text is at hand
    wanted = asks.select("source", "place", "after").distinct().groupBy("source").agg(F.collect_set(F.struct("place", "after")).alias("_places"))
    wanted = wanted.join(ids, F.col("source") == F.col("id")).select(F.col("id").alias("_source"), F.col("key").alias("_source_key"), "_places")
    kind = rows.schema["_id"].dataType.simpleString()

    def start():
        def one(key, text, *others):
            data, out = (text or "").encode(), []
            for place, after in ((x["place"], x["after"]) for x in others[-1]):
                out.append((key, place, after, data[place : place + reach] if after else data[max(0, place - reach) : place]))
            return out

        return one

    asked = rows.join(wanted.hint("merge"), _on_row("_source", "_source_key")).drop("_source", "_source_key")
    told = map_rows(asked, f"s {kind}, p int, a boolean, bytes binary", start)
    told = told.groupBy("s", "p", "a").agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    size = F.length("bytes")
    near = F.when(F.col("after"), F.substring(F.col("bytes"), F.lit(1), F.col("gap"))).otherwise(F.substring(F.col("bytes"), F.greatest(F.lit(1), size - F.col("gap") + 1), F.col("gap")))
    met = asks.join(told.hint("merge"), (F.col("source") == F.col("s")) & (F.col("place") == F.col("p")) & (F.col("after") == F.col("a")))
    return met.select("id", "key", "after", "pos", near.alias("bytes")).groupBy(F.col("id").alias("_of"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("after", "pos", "bytes")).alias("around"))


def _alike(a: bytes, b: bytes) -> int:
    """How many bytes two byte strings have in common at their start."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def passages(data: bytes, repeats: Sequence, around: Callable[[bool, int, object, int], bytes], min_run: int) -> list[tuple]:
    """Runs of neighbouring repeats (begin, end, source, at), extended, of at least ``min_run`` bytes, as (begin, end, source of the first chunk).

    ``around(after, pos, source, place)`` gives the bytes that follow, or precede, the source's place.
    """
    runs: list[list] = []
    for begin, end, source, at in repeats:
        if runs and runs[-1][1] == begin:
            runs[-1][1], runs[-1][3] = end, (source, at + end - begin)
        else:
            runs.append([begin, end, (source, at), (source, at + end - begin)])
    out: list[list] = []
    for k, (begin, end, first, last) in enumerate(runs):
        least, most = out[-1][1] if out else 0, runs[k + 1][0] if k + 1 < len(runs) else len(data)
        begins = around(False, begin, *first)
        begin -= _alike(data[max(least, begin - len(begins)) : begin][::-1], begins[::-1])
        ends = around(True, end, *last)
        end += _alike(data[end : min(most, end + len(ends))], ends)
        if out and out[-1][1] == begin:
            out[-1][1] = end
        else:
            out.append([begin, end, first[0]])
    return [tuple(run) for run in out if run[1] - run[0] >= min_run]


def whole_words(data: bytes, begin: int, end: int) -> tuple[int, int]:
    """The span without the words that it cuts, or where no white space is near, the characters."""
    if begin and not data[begin - 1 : begin].isspace():
        space = next((k for k in range(begin, min(begin + LONGEST_WORD, end)) if data[k : k + 1].isspace()), None)
        if space is not None:
            begin = space
        else:
            while begin < end and data[begin] & 0xC0 == 0x80:
                begin += 1
    if end < len(data) and not data[end : end + 1].isspace():
        space = next((k for k in range(end, max(end - LONGEST_WORD, begin), -1) if data[k - 1 : k].isspace()), None)
        if space is not None:
            end = space
        else:
            while end > begin and data[end] & 0xC0 == 0x80:
                end -= 1
    return begin, end


def dedup_substrings(df: DataFrame, chunking: Chunking = Chunking(), min_run: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: its id, the columns to ``carry`` along, clean_text, removed_bytes and runs (begin, end, source_id)."""
    kinds = [df.schema[name].dataType.simpleString() for name in (id_col, *carry)]
    names = ["id", *(f"_carried_{k}" for k in range(len(carry)))]
    # Written, so that texts are chunked once, and their repeats are found once.
    found = cut(_chunks(df, chunking, id_col, text_col))
    repeats = cut(repeated_chunks(found))
    reach = chunking.most
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(name).alias(f"_carried_{k}") for k, name in enumerate(carry)))
    around = surroundings(rows, repeats, found.select("id", "key"), reach)
    known = repeats.join(around, F.col("id").eqNullSafe(F.col("_of")) & (F.col("key") == F.col("_key")), "left").select(F.col("id").alias("_of"), F.col("key").alias("_key"), "repeats", "around")
    rows = rows.join(known, _on_row("_of", "_key"), "left").drop("_of", "_key")

    def start():
        def one(key, text, *others):
            *others, repeats, around = others
            data = (text or "").encode()
            told = {(x["after"], x["pos"]): x["bytes"] for x in around or ()}

            def beside(after, pos, source, place):
                if source != key:
                    return told.get((after, pos), b"")
                if place >= pos:  # the place of another row of this id
                    return b""
                return data[place : place + reach] if after else data[max(0, place - reach) : place]

            runs, kept, last = [], [], 0
            for begin, end, source in passages(data, [(x["begin"], x["end"], x["source"], len(data) if x["at"] is None else x["at"]) for x in repeats or ()], beside, min_run):
                begin, end = whole_words(data, begin, end)
                if begin < end:
                    kept.append(data[last:begin])
                    runs.append({"begin": begin, "end": end, "source_id": source})
                    last = end
            kept.append(data[last:])
            return [(key, *others, b"".join(kept).decode(), sum(x["end"] - x["begin"] for x in runs), runs)]

        return one

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds)) + f", clean_text string, removed_bytes long, runs array<struct<begin:int,end:int,source_id:{kinds[0]}>>"
    return map_rows(rows, schema, start).withColumnsRenamed(dict(zip(names, (id_col, *carry))))
