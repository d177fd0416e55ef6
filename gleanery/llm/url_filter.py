"""URL rules answered by Bloom filter cascades.

The universe is every key that a corpus's URLs can ask about: a host suffix with a
path prefix, of the shapes (labels, path length) that the rules have. Level 0 of a
cascade encodes the listed keys, level 1 the universe's other keys that level 0
takes for listed, level 2 the listed keys that level 1 takes for those, and so on
until no key is mistaken. Membership is then exact for the whole universe, and each
URL is judged by expressions over constants, without a join.

Level 0 has about 1.44 log2(unlisted / listed) bits a listed key and the others a
constant number, so a cascade grows with the list, and with the corpus only as its
logarithm. Cascades of up to ``CONSTANT_BITS`` are constants of an expression, so that URLs are judged without a join. A
larger one lies in tables of 64-bit words, a level each: a key asks for the words that its
places are in, by their number, so that no row carries a bitmap and no word is hot. Both give the
same answers; lists may be tables of any size.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits
no rule; a URL without a path fits no rule, as every rule has one; of rules of equal
length that fit, the last in alphabetical order counts; equal URLs get equal rows; an
empty table gives an empty result; an empty list fits nothing; columns other than the
two named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut

#: Bits that all levels of a constant cascade have together, about (1 MB: some 600,000 keys in a corpus of a hundred times as many).
CONSTANT_BITS = 1 << 23
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column, as the rules see them; both empty where there is none."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    empty = F.lit("")
    return F.when(known, F.translate(host, CAPITALS, SMALL)).otherwise(empty), F.when(known, path).otherwise(empty)


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys, of the given shapes, that a URL can be listed under; longest first."""
    labels = F.size(F.split(host, r"\."))
    keys = [F.when((labels >= n) & (F.length(path) >= size) & (host != ""), F.struct((F.length(F.substring_index(host, ".", -n)) + size).alias("length"), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)).alias("key"))) for n, size in shapes]
    ordered = F.sort_array(F.filter(F.array(*keys), lambda x: x.isNotNull()), asc=False)
    return F.transform(ordered, lambda x: x["key"])


def positions(key: Column, number: int, bits: int, hashes: int) -> Column:
    """Where a level's bitmap has a key."""
    first = F.pmod(F.xxhash64(key, F.lit(2 * number)), F.lit(bits).cast("long"))
    step = F.pmod(F.xxhash64(key, F.lit(2 * number + 1)), F.lit(bits).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: F.pmod(first + step * j, F.lit(bits).cast("long")))


@dataclass
class Level:
    """A bitmap of one side's keys: its words as a constant, or in a table (word, bits64)."""

    number: int
    bits: int
    hashes: int
    words: list[int] = field(default_factory=list)
    table: DataFrame | None = None

    def places(self, key: Column) -> Column:
        return positions(key, self.number, self.bits, self.hashes)

    def has(self, key: Column) -> Column:
        """Whether the level takes a key for one of its own, by the constant."""
        words = F.from_json(F.lit(str(self.words)), "array<bigint>")  # folded to a constant
        return F.forall(self.places(key), lambda p: F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)

    def takes(self, keys: DataFrame) -> DataFrame:
        """Those of distinct ``keys`` (key) that the level takes for its own."""
        if self.table is None:
            return keys.where(self.has(F.col("key")))
        places = keys.select("key", F.explode(self.places(F.col("key"))).alias("p"))
        asked = places.select("key", F.floor(F.col("p") / 64).alias("word"), F.pmod("p", F.lit(64)).cast("int").alias("at"))
        hits = asked.join(self.table.hint("merge"), "word").where(F.getbit("bits64", F.col("at")) == 1)
        return hits.select("key") if self.hashes == 1 else hits.groupBy("key").count().where(F.col("count") == self.hashes).select("key")


def _words(places: DataFrame) -> DataFrame:
    """The 64-bit words of a bitmap from the places (p) that are set."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    return places.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits64"))


class Cascade:
    """Exact membership of the keys of a universe."""

    def __init__(self, labelled: DataFrame, constant_bits: int = CONSTANT_BITS):
        """``labelled``: distinct keys of universe and list, and whether each is listed."""
        counts = {row["listed"]: row["count"] for row in labelled.groupBy("listed").count().collect()}
        ask = [counts.get(True, 0), counts.get(False, 0)]
        miss = min(0.5, math.sqrt(0.5) * ask[0] / max(1, ask[1]))
        first = max(1, round(math.log2(1 / miss)))
        # The levels after the first have about 2.4 keys, of one hash each, to a listed one.
        self.constant = 1.4427 * ask[0] * (first + 2.4) <= constant_bits
        self.levels: list[Level] = []
        sides = [labelled.where("listed").select("key"), labelled.where("not listed").select("key")]
        while ask[len(self.levels) % 2]:
            number = len(self.levels)
            own, other = number % 2, (number + 1) % 2
            hashes = first if number == 0 else 1
            level = Level(number, max(64, math.ceil(1.4427 * ask[own] * hashes)), hashes)
            words = _words(sides[own].select(F.explode(level.places(F.col("key"))).alias("p")))
            if self.constant:
                level.words = [0] * math.ceil(level.bits / 64)
                for row in words.collect():  # of bounded size
                    level.words[row["word"]] = row["bits64"]
            else:
                level.table = cut(words)
            self.levels.append(level)
            # Those of the other side that this level takes for its own are what the next encodes.
            taken = level.takes(sides[other])
            sides[other] = taken if self.constant else cut(taken)
            ask[other] = sides[other].count()

    def __call__(self, key: Column) -> Column:
        """Whether a key is listed, from constants."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.has(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer

    def listed(self, keys: DataFrame) -> DataFrame:
        """Those of distinct ``keys`` (key) that are listed: of each odd level, the keys that come to it and that it doesn't take."""
        left, found = keys.select("key"), keys.select("key").limit(0)
        for level in self.levels:
            taken = cut(level.takes(left))
            if level.number % 2:
                found = found.unionByName(left.join(taken.hint("merge"), "key", "left_anti"))
            left = taken
        return found.unionByName(left) if len(self.levels) % 2 else found

    def mark(self, keys: DataFrame, name: str) -> DataFrame:
        """``keys`` (a column key) with the column ``name``: whether each is listed."""
        if self.constant:
            return keys.withColumn(name, self(F.col("key")))
        found = cut(self.listed(cut(keys.select("key").distinct()))).select(F.col("key").alias("_listed"))
        return keys.join(found.hint("merge"), F.col("key") == F.col("_listed"), "left").withColumn(name, F.col("_listed").isNotNull()).drop("_listed")


def rule_rows(rules: Sequence[Rule] | DataFrame, like: DataFrame) -> DataFrame:
    """Rules, or a table (verdict, host, path) of any size, as distinct rows with their key."""
    rows = rules if isinstance(rules, DataFrame) else like.sparkSession.createDataFrame([(rule.verdict, rule.host, rule.path) for rule in rules], "verdict string, host string, path string")
    rows = rows.select("verdict", "host", "path", F.concat("host", "path").alias("key")).distinct()
    if not rows.where(F.coalesce(F.col("host").contains("/") | ~F.startswith("path", F.lit("/")) | F.col("verdict").isNull(), F.lit(True))).isEmpty():
        raise ValueError("a rule is a verdict, a host and a path that starts with /")
    if not rows.groupBy("key").agg(F.count_distinct("verdict").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a rule has two verdicts")
    return rows


def filter_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", constant_bits: int = CONSTANT_BITS) -> DataFrame:
    """Per row: its id, host, path, rule (the longest that fits, else null) and verdict."""
    table = rule_rows(rules, df)
    # Of all rules, however many, the driver sees their shapes and verdicts alone.
    shapes = sorted((row[0], row[1]) for row in table.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    kinds = sorted(row[0] for row in table.select("verdict").distinct().collect())
    host, path = url_parts(F.col(url_col))
    urls = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    urls = urls.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = urls.select(F.explode("_keys").alias("key")).distinct()
    labelled = cut(universe.withColumn("verdict", F.lit(None).cast("string")).unionByName(table.select("key", "verdict")).groupBy("key").agg(F.max("verdict").alias("verdict")))
    cascades = {kind: Cascade(labelled.select("key", F.coalesce(F.col("verdict") == kind, F.lit(False)).alias("listed")), constant_bits) for kind in kinds}
    if all(cascade.constant for cascade in cascades.values()):
        fits = F.filter(F.transform("_keys", lambda key: F.struct(key.alias("rule"), F.coalesce(*(F.when(cascades[kind](key), F.lit(kind)) for kind in kinds)).alias("verdict"))), lambda x: x["verdict"].isNotNull())
        found = urls.withColumn("_rule", F.get(fits, F.lit(0)))
    else:
        # Each different host and path asks once.
        asked = urls.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_keys").distinct().select("_host", "_path", F.posexplode("_keys").alias("_at", "key"))
        for kind in kinds:
            asked = cascades[kind].mark(asked, f"_is_{kind}")
        verdict = F.coalesce(*(F.when(F.col(f"_is_{kind}"), F.lit(kind)) for kind in kinds))
        best = asked.withColumn("verdict", verdict).where("verdict is not null").groupBy("_host", "_path").agg(F.min(F.struct("_at", F.col("key").alias("rule"), "verdict")).alias("_rule"))
        found = urls.join(cut(best).hint("merge"), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return found.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))
