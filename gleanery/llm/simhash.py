"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most ``radius`` bits. The bits
are dealt over partitions, correlated bits together, and each partition i gets a
threshold t_i of its own. If the sum of (t_i + 1) is radius + 1, two linked
fingerprints differ in at most t_i bits of some partition i; t_i = -1 leaves a
partition out. Dynamic programming picks the thresholds, for each number of
partitions, of the least estimated cost: rows that probe, plus candidate pairs
from the distribution of differing bits that the corpus's bit statistics imply.
Fingerprints then meet by the partition's bits, as they are on one side and with
up to t_i of them flipped on the other, and each meeting is verified in full.

Only distinct fingerprints take part. Dense clouds of near copies are not expanded
into pairs: fingerprints first link to a few pivots of each bucket, and the
probes afterwards look only for links between different components of those.

Edge cases: a null or wordless text has fingerprint zero and links like any other;
fewer words than a shingle make one shingle; whole texts are read; repeated rows
share a fingerprint; null ids lose against others; an empty table gives an empty
result; columns other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb, log

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, map_rows, small_or_merged
from gleanery.llm.components import components

BITS = 64
SEED = 42
#: Hashes whose bits are summed at a time.
BLOCK = 1 << 14
#: Cost of a probing row, in candidate pairs.
PROBE_COST = 30.0
#: Numbers of partitions that are tried.
PARTITIONS = range(2, 9)
#: Most bits that a probe may flip in one partition.
MOST_FLIPS = 3


def fingerprint(text: str | None, width: int = 4, distinct: bool = False) -> int:
    """The SimHash of a text's word shingles; ``distinct`` counts equal shingles once."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
    if distinct:
        hashes = np.unique(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, width: int = 4, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fp, the fingerprint's 64 bits as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        return lambda key, text: [(key, _signed(fingerprint(text, width, distinct)))]

    return map_rows(df.select(F.col(id_col), F.col(text_col)), f"id {kind}, fp long", start)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for all pairs of bits how many have both; 4,096 sums reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(values), BLOCK):
                bits = np.unpackbits(values[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.reshape(-1))], names=["pair", "n"])

    sums = prints.select("fp").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for row in sums:
        both[row["pair"]] = row["n"]
    return prints.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about equal size; each takes the bits that correlate most with it."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (tie[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            nearest = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def differing(n: int, both: np.ndarray, group: list[int]) -> np.ndarray:
    """Probability that two random fingerprints differ in 0, 1, ... bits of ``group``."""
    share = np.diag(both)[group] / max(n, 1)
    odds = np.array([1.0])
    for p in 2 * share * (1 - share):
        odds = np.append(odds, 0) * (1 - p) + np.append(0, odds) * p
    return odds


def allocate(n: int, both: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Partitions, as (mask, threshold), of the least estimated cost; thresholds of at least 0 only."""
    best: tuple[float, list[tuple[int, int]]] | None = None
    for parts in PARTITIONS:
        groups = group_bits(n, both, parts)
        costs = []
        for group in groups:
            odds = np.cumsum(differing(n, both, group))
            costs.append([0.0] + [PROBE_COST * n * (1 + sum(comb(len(group), k) for k in range(t + 1))) + n * n / 2 * odds[t] for t in range(min(MOST_FLIPS, len(group)) + 1)])
        # spent[s]: the least cost of thresholds whose sum of t + 1 is s.
        spent: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            following: dict[int, tuple[float, list[int]]] = {}
            for total, (paid, chosen) in spent.items():
                for step, price in enumerate(cost):
                    key = total + step
                    if key <= radius + 1 and (key not in following or paid + price < following[key][0]):
                        following[key] = (paid + price, [*chosen, step - 1])
            spent = following
        if radius + 1 in spent and (best is None or spent[radius + 1][0] < best[0]):
            paid, chosen = spent[radius + 1]
            best = paid, [(sum(1 << b for b in group), t) for group, t in zip(groups, chosen) if t >= 0]
    if best is None:
        raise ValueError(f"no thresholds for a radius of {radius}")
    return best[1]


def flips(mask: int, threshold: int) -> list[int]:
    """What to flip, as signed longs, to reach every value within ``threshold`` bits of ``mask``."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(chosen)) for k in range(threshold + 1) for chosen in combinations(bits, k)]


def _far(a, b, mask: int | None = None):
    differ = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(differ if mask is None else differ.bitwiseAND(F.lit(_signed(mask))))


def _long_array(values: list[int]):
    return F.from_json(F.lit(str(values)), "array<bigint>")


def classes(prints: DataFrame, radius: int, pivots: int = 2) -> DataFrame:
    """For each of distinct fingerprints (column fp): fp and root, the least fingerprint that links lead to."""
    prints = cut(prints.select("fp"))
    n, both = bit_statistics(prints)
    plan = allocate(n, both, radius)
    masks = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(_signed(mask)).alias("mask")) for k, (mask, _) in enumerate(plan)))
    buckets = prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("m.part").alias("part"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("sig"))

    # A few members of each bucket, picked by hashes, are its pivots.
    picks = [F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"p{k}") for k in range(pivots)]
    pivot = cut(buckets.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n"), *picks).where("n > 1").select("part", "sig", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(pivots))))).alias("pivot")))
    near = (F.col("l.part") == F.col("r.part")) & (F.col("l.sig") == F.col("r.sig")) & (_far("fp", "pivot") <= radius) & (F.col("fp") != F.col("pivot"))
    stars = cut(buckets.alias("l").join(pivot.alias("r"), near).select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    roots = components(stars)
    labelled = cut(prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("label")))

    index = labelled.select("fp", "label", F.explode(masks).alias("m")).select("fp", "label", F.col("m.part").alias("part"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("sig"))

    def probing(part: int, mask: int, threshold: int) -> DataFrame:
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        reached = F.transform(_long_array(flips(mask, threshold)), lambda x: own.bitwiseXOR(x))
        return labelled.select(F.col("fp").alias("fp2"), F.col("label").alias("label2"), F.lit(part).alias("part2"), F.explode(reached).alias("sig2"))

    flipped = [probing(k, mask, threshold) for k, (mask, threshold) in enumerate(plan)]
    probes = flipped[0]
    for more in flipped[1:]:
        probes = probes.unionByName(more)
    # A bucket of one label only has nothing for a probe of that label: members of a dense
    # cloud, which share a label by now, don't meet each other again.
    held = cut(index.groupBy("part", "sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high")))
    held = held.select(F.col("part").alias("_part"), F.col("sig").alias("_sig"), "_low", "_high")
    asked = (F.col("part2") == F.col("_part")) & (F.col("sig2") == F.col("_sig")) & ((F.col("label2") != F.col("_low")) | (F.col("label2") != F.col("_high")))
    probes = probes.join(held.hint("merge"), asked).select("fp2", "label2", "part2", "sig2")
    meet = (F.col("part") == F.col("part2")) & (F.col("sig") == F.col("sig2")) & (F.col("fp") < F.col("fp2")) & (F.col("label") != F.col("label2")) & (_far("fp", "fp2") <= radius)
    # What links components of stars links all of them; only their labels go on.
    pairs = probes.join(index.hint("merge"), meet).select(F.col("label").alias("a"), F.col("label2").alias("b"))
    joined = components(pairs)
    return labelled.join(joined, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("root"))


def near_duplicates(df: DataFrame, radius: int = 4, width: int = 4, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, fingerprint (16 hexadecimal digits) and component_id, the smallest id it is linked to."""
    rows = cut(fingerprints(df, width, distinct, id_col, text_col))
    first = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    members = cut(first.join(classes(first, radius), "fp"))
    # Written first, so that the join can split a component of very many fingerprints.
    smallest = cut(members.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id")))
    named = cut(members.join(smallest.hint("merge"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(named, F.col("fp") == F.col("_fp")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of sampled shingles that each text has besides that of all its shingles, and shingles in each.
VIEWS, VIEW_SHINGLES = 16, 4
#: Members of a bucket that are compared with all of it.
PIVOTS = 3
#: 64-bit words of the sketches that bound how much two sets share.
WORDS = 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; fewer words than a shingle make one."""
    words = (text or "").encode().lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of some hashes, as a signed long."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def view_factors(views: int = VIEWS, seed: int = SEED) -> np.ndarray:
    """Odd numbers; multiplication by one orders hashes anew."""
    return np.random.default_rng(seed).integers(0, 1 << 63, views, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def view_prints(hashes: np.ndarray, factors: np.ndarray, shingles: int = VIEW_SHINGLES) -> list[int]:
    """For each factor the SimHash of the shingles that it puts first; texts that share those share the fingerprint."""
    out = []
    for factor in factors:
        order = hashes * factor
        if len(order) > shingles:
            order = np.partition(order, shingles - 1)[:shingles]
        out.append(majority(order))
    return out


def text_prints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, node (MD5 of its text), fp (SimHash of its shingles), size (its shingles) and views."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        factors = view_factors()

        def one(key, text):
            hashes = shingle_hashes(text, width)
            return [(key, hashlib.md5((text or "").encode()).digest(), majority(hashes), len(hashes), view_prints(hashes, factors))]

        return one

    return map_rows(df.select(F.col(id_col), F.col(text_col)), f"id {kind}, node binary, fp long, size int, views array<long>", start)


def text_node(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """Per row of node and text: node and the distinct hashes of the text's word shingles."""

    def start():
        return lambda node, text: [(node, shingle_hashes(text, width).view(np.int64))]

    return map_rows(texts.select("node", "text"), "node binary, shingles array<long>", start, output_rows=500)


def _alike(left: str, right: str, similarity: float):
    # Sets of too different sizes can't be alike; only the others are intersected.
    ours, theirs = F.size(left), F.size(right)
    near = (ours >= F.lit(similarity) * theirs) & (theirs >= F.lit(similarity) * ours)
    common = F.size(F.array_intersect(left, right))
    return near & (common >= F.lit(similarity) * (ours + theirs - common))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike."""
    left = pairs.join(sets.select(F.col("node").alias("_a"), F.col("shingles").alias("_ours")).hint("merge"), F.col("a") == F.col("_a"))
    both = left.join(sets.select(F.col("node").alias("_b"), F.col("shingles").alias("_theirs")).hint("merge"), F.col("b") == F.col("_b"))
    return cut(both.where(_alike("_ours", "_theirs", similarity)).select("a", "b"))


def _pairs_between(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that can be alike, by a prefix filter on rare shingles.

    ``sets`` has node, label and shingles. Only shingles that two labels have are
    shared by any pair asked for. If a set of n shingles is alike to a larger one they
    share at least 2s / (1 + s) * n, and at least s * n if to a smaller one, so that
    they meet in the first of each in any order that all sets follow: rare ones come
    first. Sketches of those shingles, a bit for each, tell how many of one set's the
    other lacks at least; they turn nearly all other pairs away before these leave
    the join. Neither bound loses a pair.
    """
    s = F.lit(similarity)
    # Labels are told apart by hashes here, so that they take little room.
    spread = sets.select("node", F.xxhash64("label").alias("label"), F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
    shared = cut(shared.select(F.col("shingle").alias("_shared"), "_n"))
    met = spread.join(shared.hint("merge"), F.col("shingle") == F.col("_shared"))
    own = Window.partitionBy("node")
    place = F.pmod("shingle", F.lit(64 * WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = [F.bit_or(F.when(F.floor(place / 64) == k, bit).otherwise(F.lit(0).cast("long"))).over(own).alias(f"w{k}") for k in range(WORDS)]
    met = met.select("node", "label", "size", "shingle", F.row_number().over(own.orderBy("_n", "shingle")).alias("_nth"), F.count(F.lit(1)).over(own).alias("met"), *words)
    # What isn't shared with another label comes first in the order.
    place = F.col("size") - F.col("met") + F.col("_nth")
    smaller = F.col("size") - F.ceil(2 * s / (1 + s) * F.col("size") - F.lit(1e-9)) + 1
    larger = F.col("size") - F.ceil(s * F.col("size") - F.lit(1e-9)) + 1
    prefix = cut(met.where((F.col("met") >= s * F.col("size") - F.lit(1e-9)) & (place <= larger)).withColumn("lead", place <= smaller).drop("_nth"))
    small = prefix.where("lead").drop("lead")
    large = prefix.drop("lead").select(*(F.col(name).alias(f"{name}_2") for name in prefix.columns if name != "lead"))
    least = s / (1 + s) * (F.col("size") + F.col("size_2")) - F.lit(1e-9)

    def shares(one: str, other: str):
        lacking = sum((F.bit_count(F.col(f"w{k}{one}").bitwiseAND(F.bitwise_not(F.col(f"w{k}{other}")))) for k in range(1, WORDS)), F.bit_count(F.col(f"w0{one}").bitwiseAND(F.bitwise_not(F.col(f"w0{other}")))))
        return F.col(f"met{one}") - lacking

    order = (F.col("size") < F.col("size_2")) | ((F.col("size") == F.col("size_2")) & (F.col("node") != F.col("node_2")))
    meet = (F.col("shingle") == F.col("shingle_2")) & (F.col("label") != F.col("label_2")) & order & (F.col("size") >= s * F.col("size_2") - F.lit(1e-9)) & (shares("", "_2") >= least) & (shares("_2", "") >= least)
    pairs = small.join(large.hint("merge"), meet)
    return cut(pairs.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct())


def verified_groups(df: DataFrame, radius: int = 4, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of a near copy that doesn't stay: its id, node (``text_node`` of its text) and group_id, the id of the row that stays.

    Groups are connected by pairs of texts whose distinct word shingles have a Jaccard
    similarity of at least ``similarity``. Candidates meet in buckets: the class of their
    SimHash over all shingles (generalised pigeonhole, ``radius`` bits), and equal
    SimHashes over each of ``VIEWS`` small samples of shingles, which find what differs in
    more bits (at 0.8, all but 0.02 % of pairs share one). A few pivots are compared with
    all of their bucket. Texts of larger buckets that are still in different groups meet
    by rare shingles, so that no pair of candidates is left out and yet a cloud of copies
    isn't expanded into pairs. Of a group the smallest id stays, null ids last.
    """
    prints = cut(text_prints(df, width, id_col, text_col))
    best = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    nodes = cut(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("views").alias("views"), F.min(best).alias("best")))
    roots = classes(nodes.select("fp").distinct(), radius)
    classed = nodes.select("node", "fp").join(roots.withColumnRenamed("fp", "_fp").hint("merge"), F.col("fp") == F.col("_fp")).select("node", F.lit(-1).alias("view"), F.col("root").alias("key"))
    rows = classed.unionByName(nodes.select("node", F.posexplode("views").alias("view", "key")))

    picks = [F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    several = rows.groupBy("view", "key").agg(F.count(F.lit(1)).alias("n"), *picks).where("n > 1")
    several = cut(several.select(F.col("view").alias("_view"), F.col("key").alias("_key"), F.col("n"), F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("pivots")))
    buckets = cut(rows.join(several.hint("merge"), (F.col("view") == F.col("_view")) & (F.col("key") == F.col("_key"))).select("node", "view", "key", "n", "pivots"))
    edges = buckets.select("node", F.explode("pivots").alias("pivot")).where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    members = cut(buckets.select("node").distinct())
    texts = df.select(text_node(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(small_or_merged(members), "node", "left_semi")
    sets = cut(shingle_sets(texts.groupBy("node").agg(F.first("text").alias("text")), width))
    links = _verified(edges, sets, similarity)

    first = components(links)
    named = cut(buckets.where(F.col("n") > PIVOTS + 1).select("node", "view", "key").join(first.withColumnsRenamed({"node": "_node", "root": "_root"}).hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "view", "key", F.coalesce("_root", "node").alias("label")))
    mixed = named.groupBy("view", "key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
    mixed = cut(mixed.select(F.col("view").alias("_view"), F.col("key").alias("_key")))
    open_nodes = cut(named.join(mixed.hint("merge"), (F.col("view") == F.col("_view")) & (F.col("key") == F.col("_key")), "left_semi").select("node", "label").distinct())
    asked = sets.withColumnRenamed("node", "_node").join(open_nodes.hint("merge"), F.col("_node") == F.col("node")).select("node", "label", "shingles")
    more = _verified(_pairs_between(asked, similarity), sets, similarity)
    stars = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    groups = cut(components(stars.unionByName(more)))

    grouped = nodes.select("node", "best").join(groups.withColumnRenamed("node", "_node").hint("merge"), F.col("node") == F.col("_node"), "left")
    grouped = cut(grouped.select("node", "best", F.coalesce("root", "node").alias("root")))
    stays = grouped.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct("best", "node")).alias("_stays"))
    told = prints.select("id", F.col("node").alias("_node")).join(grouped.hint("merge"), F.col("_node") == F.col("node")).join(cut(stays).hint("merge"), F.col("root") == F.col("_root"))
    dropped = told.where((F.col("node") != F.col("_stays.node")) | ~F.col("id").eqNullSafe(F.col("_stays.best.id")))
    return cut(dropped.select(F.col("id").alias(id_col), "node", F.col("_stays.best.id").alias("group_id")))
