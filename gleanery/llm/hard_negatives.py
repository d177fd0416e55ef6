"""Hard negatives by product quantisation with rigorous bounds.

Vectors are integers here. Each is cut into subspaces of a few components, a subspace is
replaced by its nearest centroid, and the length of what that leaves out (the residual)
is stored. For an anchor a, a table of the products with all centroids gives the
score of the quantised vector by lookups; the true score differs from it by at most
the sum over subspaces of |a| times the residual's length. Rows whose bound can't reach
a window, or the k-th score already found in it, are left out, and the rest get
exact integer scores, so the result is that of comparing all rows.

The centroids come from a bounded sample and decide only how many rows are left out.
Anchors are a stated set: they are sent to every task in parts of a bounded number of
values, and rows are read twice a part, for the positives and for the negatives. A task
keeps the first k of each window and hands nothing else on.

Edge cases: rows without an id, a label or a vector, or with a null or non-finite
component, take no part, nor do vectors whose integer form has a squared length of 2**52
or more, as their scores might not be exact; vectors meet those of their own dimension;
equal rows count each as positives and negatives and once as an anchor, and rows of
the anchor's id are never its positives or negatives; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import BATCH_BYTES, cut
from gleanery.shipping import ship_package

#: Components become the floor of so many times their value.
SCALE = 256
#: Components of a subspace.
WIDTH = 2
#: Centroids of a subspace, at most.
CENTROIDS = 256
#: Numbers, at most, that centroids are made from: so many rows of a dimension as have them.
SAMPLE_VALUES = 500_000
#: The most frequent dimensions that get centroids; vectors of others have bounds from their length alone.
DIMENSIONS = 16
ROUNDS = 8
#: Values of anchors that are sent to every task at a time.
ANCHOR_VALUES = 2_000_000
#: Anchors and rows that are compared at a time.
ANCHOR_BLOCK, ROW_BLOCK = 256, 2048
ENCODED = "id long, label long, vector binary, codes binary, residuals binary"


def integer_rows(df: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """The rows that take part: id, label and the integer vector."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists("_x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("_x")).where("id is not null and label is not null and _x is not null").where(~bad)
    whole = rows.select("id", "label", F.transform("_x", lambda x: F.floor(x * SCALE)).alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return whole.where(length < float(2**52)).select("id", "label", F.col("vector").cast("array<int>").alias("vector"))


def cut_points(size: int) -> list[tuple[int, int]]:
    return [(at, min(size, at + WIDTH)) for at in range(0, size, WIDTH)]


def centroids(sample: np.ndarray) -> list[np.ndarray]:
    """Centroids of each subspace of a sample, by Lloyd's rounds from evenly spaced rows."""
    found = []
    for a, b in cut_points(sample.shape[1]):
        points = sample[:, a:b]
        unique = np.unique(points, axis=0)
        centers = unique[np.linspace(0, len(unique) - 1, min(CENTROIDS, len(unique))).astype(int)]
        for _ in range(ROUNDS):
            nearest = _nearest(points, centers)
            counts = np.bincount(nearest, minlength=len(centers))
            sums = np.stack([np.bincount(nearest, weights=points[:, k], minlength=len(centers)) for k in range(points.shape[1])], axis=1)
            centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        found.append(centers)
    return found


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    half = (centers * centers).sum(1) / 2
    for first in range(0, len(points), 8192):
        out[first : first + 8192] = (points[first : first + 8192] @ centers.T - half).argmax(1)
    return out


def train(rows: DataFrame, sample_values: int = SAMPLE_VALUES) -> dict[int, list[np.ndarray]]:
    """Centroids by dimension, from the rows with the lowest hashes of the most frequent dimensions."""
    sized = rows.withColumn("size", F.size("vector"))
    sizes = sized.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), "size").limit(DIMENSIONS).collect()
    found = {}
    for size in (row["size"] for row in sizes):
        taken = sized.where(F.col("size") == size).orderBy(F.xxhash64("id", "vector"), "id").limit(max(1, sample_values // size)).select("vector").collect()
        found[size] = centroids(np.array([row["vector"] for row in taken], dtype=np.float64))
    return found


def encode_block(vectors: np.ndarray, books: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the lengths of residuals of each subspace; without centroids the whole vector is residual."""
    cuts = cut_points(vectors.shape[1])
    codes = np.zeros((len(vectors), len(cuts)), dtype=np.uint8)
    left = np.zeros((len(vectors), len(cuts)), dtype=np.float64)
    for m, (a, b) in enumerate(cuts):
        points = vectors[:, a:b]
        if books is not None:
            codes[:, m] = _nearest(points, books[m])
            points = points - books[m][codes[:, m]]
        left[:, m] = np.sqrt((points * points).sum(1))
    # Rounded up, so that the bound holds.
    return codes, np.nextafter((left * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _by_size(column) -> dict[int, np.ndarray]:
    """Row numbers by the length of their binary value."""
    lengths = np.array([len(x) for x in column], dtype=np.int64)
    return {int(size): np.flatnonzero(lengths == size) for size in np.unique(lengths)}


def _matrix(values: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def encode(rows: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """All rows with their codes and the lengths of their residuals."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            ids, labels, given = (batch.column(name).to_pylist() for name in ("id", "label", "vector"))
            packed = [np.array(x, dtype="<i4").tobytes() for x in given]
            codes, left = [b""] * len(packed), [b""] * len(packed)
            for size, at in _by_size(packed).items():
                if size:
                    block = _matrix([packed[k] for k in at], "<i4").astype(np.float64)
                    own, lengths = encode_block(block, known.get(size // 4))
                    for k, c, r in zip(at, own, lengths):
                        codes[k], left[k] = c.tobytes(), r.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(packed, pa.binary()), pa.array(codes, pa.binary()), pa.array(left, pa.binary())],
                names=["id", "label", "vector", "codes", "residuals"],
            )

    return rows.mapInArrow(run, ENCODED)


class Windows:
    """The first ``k`` rows in each window of scores of each anchor, while rows pass by.

    ``anchors`` are (id, label, vector) of one dimension; ``windows`` are (anchor's
    number, least score, greatest score), of each anchor in turn. ``pairs`` and ``exact`` count
    what was compared and what the bounds left.
    """

    def __init__(self, anchors: list[tuple[int, int, bytes]], windows: list[tuple[int, float, float]], books: list[np.ndarray] | None, k: int, same_label: bool):
        self.ids = np.array([x[0] for x in anchors], dtype=np.int64)
        self.labels = np.array([x[1] for x in anchors], dtype=np.int64)
        self.vectors = _matrix([x[2] for x in anchors], "<i4").astype(np.float64)
        self.books, self.k, self.same_label = books, k, same_label
        self.cuts = cut_points(self.vectors.shape[1])
        self.lengths = np.stack([np.sqrt((self.vectors[:, a:b] ** 2).sum(1)) for a, b in self.cuts], axis=1)
        self.windows = windows
        self.of: list[list[int]] = [[] for _ in anchors]
        for number, (anchor, _, _) in enumerate(windows):
            self.of[anchor].append(number)
        none = (np.empty(0, dtype=np.float64), np.empty(0, dtype=np.int64))
        self.best = [none for _ in windows]
        self.need = np.array([min((windows[w][1] for w in own), default=np.inf) for own in self.of])
        self.most = np.array([max((windows[w][2] for w in own), default=-np.inf) for own in self.of])
        self.pairs = self.exact = 0

    def pass_by(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, residuals: np.ndarray) -> None:
        for first in range(0, len(ids), ROW_BLOCK):
            rows = slice(first, first + ROW_BLOCK)
            for start in range(0, len(self.ids), ANCHOR_BLOCK):
                self._block(start, ids[rows], labels[rows], vectors[rows], codes[rows], residuals[rows])

    def _block(self, start, ids, labels, vectors, codes, residuals) -> None:
        own = slice(start, min(start + ANCHOR_BLOCK, len(self.ids)))
        rough = np.zeros((own.stop - start, len(ids)))
        if self.books is not None:
            for m, (a, b) in enumerate(self.cuts):
                rough += (self.vectors[own, a:b] @ self.books[m].T)[:, codes[:, m]]
        error = self.lengths[own] @ residuals.T
        error += 1e-9 * (np.abs(rough) + error) + 1e-3  # of floating point
        fits = (labels[None, :] == self.labels[own, None]) == self.same_label
        fits &= ids[None, :] != self.ids[own, None]
        self.pairs += int(fits.sum())
        need = self.need[own].copy()
        if self.same_label and len(ids) > self.k:
            # Unbounded windows: k rows are sure to reach the k-th lower bound.
            need = np.maximum(need, -np.partition(np.where(fits, error - rough, np.inf), self.k - 1, axis=1)[:, self.k - 1])
        fits &= rough + error >= need[:, None]
        fits &= rough - error <= self.most[own, None]
        for local in np.flatnonzero(fits.any(1)):
            at = np.flatnonzero(fits[local])
            self.exact += len(at)
            self._take(start + local, ids[at], vectors[at] @ self.vectors[start + local])

    def _take(self, anchor: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in self.of[anchor]:
            _, low, high = self.windows[w]
            held, held_ids = self.best[w]
            if len(held) == self.k:
                low = max(low, held[-1])
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                both, both_ids = np.concatenate([held, scores[inside]]), np.concatenate([held_ids, ids[inside]])
                order = np.lexsort((both_ids, -both))[: self.k]
                self.best[w] = both[order], both_ids[order]
        self.need[anchor] = min(max(self.windows[w][1], self.best[w][0][-1] if len(self.best[w][0]) == self.k else -np.inf) for w in self.of[anchor])

    def found(self):
        """(window's number, id, score) of what is held."""
        for w, (scores, ids) in enumerate(self.best):
            for score, one in zip(scores.tolist(), ids.tolist()):
                yield w, one, int(score)


def first_in_windows(encoded: DataFrame, groups: dict[int, tuple[list, list, list]], books: dict[int, list[np.ndarray]], k: int, same_label: bool) -> DataFrame:
    """window, id and score of the first ``k`` rows of each window; ``groups`` has anchors, windows and the windows' numbers by dimension."""
    spark = encoded.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_package(spark)
    shared = spark.sparkContext.broadcast((groups, books))

    def run(batches):
        import pyarrow as pa

        asked, known = shared.value
        state = {size: Windows(anchors, windows, known.get(size), k, same_label) for size, (anchors, windows, _) in asked.items()}
        for batch in batches:
            packed = batch.column("vector").to_pylist()
            ids, labels = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("id", "label"))
            codes, left = batch.column("codes").to_pylist(), batch.column("residuals").to_pylist()
            for size, at in _by_size(packed).items():
                if size and size // 4 in state:
                    pick = lambda values, kind: _matrix([values[k] for k in at], kind)  # noqa: B023, E731
                    state[size // 4].pass_by(ids[at], labels[at], pick(packed, "<i4").astype(np.float64), pick(codes, "u1"), pick(left, "<f4").astype(np.float64))
        for size, windows in state.items():
            numbers, rows = asked[size][2], list(windows.found())
            for first in range(0, len(rows), 50_000):
                part = rows[first : first + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([numbers[x[0]] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], names=["window", "id", "score"])

    rows = encoded.mapInArrow(run, "window long, id long, score long")
    by = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
    least_percent: int = 80, most_percent: int = 100, anchor_values: int = ANCHOR_VALUES,
) -> DataFrame:
    """For each anchor and each of its first positives the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells the rows of the stated set by their ``id``. Scores are integer
    products, higher first, ties by the smaller id. A negative has another
    label and a score between two percentages of the positive's.
    """
    if not 0 <= least_percent <= most_percent:
        raise ValueError("the percentages are not negative and in order")
    rows = integer_rows(df, id_col, F.col("label") if label is None else label, vector_col)
    books = train(rows)
    encoded = cut(encode(rows, books))
    asked = encoded.where(anchors).select("id", "label", "vector").distinct()
    values = asked.agg(F.sum(F.length("vector") / 4)).first()[0] or 0
    parts = max(1, math.ceil(values / anchor_values))
    dealt = asked.withColumn("_part", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)))
    found = None
    for part in range(parts):
        groups: dict[int, tuple[list, list, list]] = {}
        numbered = []
        for row in dealt.where(F.col("_part") == part).select("id", "label", "vector").orderBy("id", "label", "vector").collect():  # a part of the stated set, of bounded size
            if row["vector"]:
                own, windows, numbers = groups.setdefault(len(row["vector"]) // 4, ([], [], []))
                windows.append((len(own), -np.inf, np.inf))
                numbers.append(len(numbered))
                own.append((row["id"], row["label"], bytes(row["vector"])))
                numbered.append((len(row["vector"]) // 4, len(own) - 1))
        best = first_in_windows(encoded, groups, books, positives, True).orderBy("window", "rank").collect()  # a few rows an anchor
        wanted: dict[int, tuple[list, list, list]] = {size: (own, [], []) for size, (own, _, _) in groups.items()}
        pairs = []
        for row in best:
            size, anchor = numbered[row["window"]]
            score = row["score"]
            low, high = -(-least_percent * score // 100), most_percent * score // 100
            if low <= high:
                _, windows, numbers = wanted[size]
                windows.append((anchor, float(low), float(high)))
                numbers.append(len(pairs))
                pairs.append((len(pairs), wanted[size][0][anchor][0], row["id"], score))
        told = df.sparkSession.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
        near = first_in_windows(encoded, wanted, books, negatives, False)
        own = near.join(told, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        found = own if found is None else found.unionByName(own)
    return found
