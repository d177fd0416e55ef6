"""Packing of token sequences into windows by minimum bin slack.

A document of at least one window's tokens is cut at every full window; what
remains of it, and each shorter document, is one item of fewer tokens. The number
of items of each length is a histogram of at most ``window`` counts, whatever the
corpus's size. Over it, subset-sum dynamic programming on a bitset finds the
multiset of lengths that, with the longest item left, comes closest to the
window; the multiset is repeated as often as the counts allow. Ranks within a
length then tell each item its sequence and offset.

Edge cases: a null text counts as empty and is one item holding the end token
alone; long texts are tokenised whole and cut; repeated rows are packed one by
one, in any order; an empty table gives an empty result; columns other than the
two named are ignored, whatever their names.
"""

from __future__ import annotations

import string
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import Remembered, cut, map_rows, shuffle_width

WINDOW = 4096
END_ID = 2
#: Words, and their letters, whose ids a worker remembers, in each of two generations.
CACHE_WORDS = 120_000
PUNCTUATION = string.punctuation
#: Letters before this are lower-cased alike by Python and the library.
LATIN_END = "\u0250"
#: Rows of a plan that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: its own, or for bytes that aren't printed one from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (x for x in range(256) if x not in printed)
    return {byte: chr(0x100 + k) for k, byte in enumerate(others)}


class WordTokenizer:
    """Ids of a text, word by word, as little-endian unsigned 32-bit integers.

    Only for byte-level BPE tokenizers in lower case whose pre-tokenizer takes runs
    of letters and of punctuation apart and never joins what white space parts;
    ``tests/llm`` compare it with the library over whole texts.
    """

    def __init__(self, spec: bytes, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.engine = Tokenizer.from_buffer(spec)
        self.words = Remembered(self._words, cache_words)
        self.cores = Remembered(lambda cores: list(map(self._letters, cores)), cache_words)
        self.tails = Remembered(lambda tails: list(map(self._any, tails)), cache_words)
        self.letters = byte_letters()

    def encode(self, text: str) -> bytes:
        return b"".join(self.words(text.replace("\n", " ").split(" ")))

    def _words(self, words: list[str]) -> list[bytes]:
        """Letters, and the ASCII punctuation behind them, are tokenised apart and in lower case."""
        out, cores, tails, places = [], [], [], []
        for word in words:
            low = word.lower()
            core = low.rstrip(PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < LATIN_END):
                places.append(len(out))
                cores.append(core)
                tails.append(low[len(core) :])
                out.append(b"")
            else:
                out.append(self._any(word))
        for place, core, tail in zip(places, self.cores(cores), self.tails(tails)):
            out[place] = core + tail
        return out

    def _letters(self, word: str) -> bytes:
        """Ids of lower-case letters, straight from the model."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.engine.model.tokenize(spelled)]).tobytes()

    def _any(self, text: str) -> bytes:
        return array("I", self.engine.encode(text, add_special_tokens=False).ids).tobytes()


_tokenizers: dict[int, WordTokenizer] = {}


def _tokenizer(spec: bytes) -> WordTokenizer:
    """One tokenizer for each vocabulary in a worker process."""
    key = hash(spec)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(spec)
    return _tokenizers[key]


def cut_pieces(df: DataFrame, tokenizer: bytes, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens: id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    kind = df.schema[id_col].dataType.simpleString()
    step, end = 4 * window, end_id.to_bytes(4, "little")

    def start():
        encode = _tokenizer(shared.value).encode

        def one(key, text):
            data = encode(text or "") + end
            total = len(data) // 4
            out = []
            for at in range(0, len(data), step):
                piece = data[at : at + step]
                row = (key, at // 4, len(piece) // 4, zlib.crc32(piece), total)
                out.append((*row, np.frombuffer(piece, "<u4").astype(np.int32)) if with_ids else row)
            return out

        return one

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_rows(df.select(F.col(id_col), F.col(text_col)), schema, start).withColumnRenamed("id", id_col)


def fill(counts: dict[int, int], seed: int, window: int) -> list[tuple[int, int]]:
    """The multiset of lengths, with ``seed`` in it, that leaves the least padding.

    ``counts`` are the items left. A window is padded up to its size unless its
    total is a power of two. Lengths join the bitset from the longest on until the
    window can be filled; the kept bitsets then tell how often each is taken.
    """
    room = window - seed
    full = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((bits, length, take))
            bits = (bits | bits << (length * take)) & full
            left -= take
            take *= 2
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    if total != room:
        exact = [1 << k for k in range(window.bit_length()) if seed <= 1 << k <= window and bits >> ((1 << k) - seed) & 1]
        if exact:
            total = exact[-1] - seed
    taken = {seed: 1}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= length * take
    return sorted(taken.items(), reverse=True)


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often to repeat which multiset of lengths, so that every item is used once."""
    counts = {length: count for length, count in histogram.items() if count}
    plan = []
    while counts:
        pattern = fill(counts, max(counts), window)
        times = min(counts[length] // count for length, count in pattern)
        for length, count in pattern:
            counts[length] -= times * count
            if not counts[length]:
                del counts[length]
        plan.append((times, pattern))
    return plan


def plan_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length of each multiset: length, ranks from and to, items a window, first sequence, first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in plan:
        offset = 0
        for length, count in pattern:
            first = used.get(length, 0)
            used[length] = first + times * count
            rows.append((length, first, used[length], count, sequence, offset))
            offset += length * count
        sequence += times
    return rows


def ranked(items: DataFrame, id_col: str) -> DataFrame:
    """``items`` with their ranks, from 0, among those of equal length.

    Equal lengths can be a third of all rows, so each length is dealt over salts;
    a salt's first rank is the sum of the smaller salts' counts.
    """
    salts = shuffle_width(items.sparkSession)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts)))
    inside = Window.partitionBy("length", "_salt").orderBy(id_col, "start")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    return salted.withColumn("_in", F.row_number().over(inside) - 1).join(firsts, ["length", "_salt"]).withColumn("_rank", F.col("_in") + F.col("_first")).drop("_salt", "_in", "_first")


def pack(pieces: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (as ``cut_pieces`` makes them) with their sequence_id and offset.

    Two things reach the driver: the histogram, of at most ``window`` counts, and
    from it the plan, whose rows follow the number of lengths, not of documents.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    histogram = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    rows = plan_rows(plan_windows(histogram, window))
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _each long, _sequence long, _offset long")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan
    items = ranked(pieces, id_col)
    nth = F.col("_rank") - F.col("_from")
    joined = items.join(plan, (items["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(plan["length"])
    return joined.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).alias("offset"),
    )
