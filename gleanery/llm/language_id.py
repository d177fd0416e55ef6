"""Language identification by character language models.

For each language an interpolated Kneser-Ney model of character n-grams is learned.
All of them are kept in sorted arrays of n-gram hashes, with a row of log
probabilities, one for each language, at each hash; what is in no array backs off
through the weights of its context. A text gets the language whose cross-entropy,
per character, is the lowest. On documents left out of the counts, a temperature
that turns entropies into probabilities and, per language, the highest entropy to
accept are calibrated; a text beyond that is marked as rejected.

Edge cases: a null text, and one without letters, is ``und`` with score 0; whole
texts are scored, in blocks; ties go to the first language in alphabetical order;
without training rows everything is ``und``; repeated rows are scored one by one;
an empty table gives an empty result; columns other than those named are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows

ORDER = 4
UNKNOWN = "und"
#: Documents of a language that are learned from, at most, and characters of all of them together.
SAMPLE_DOCUMENTS = 400
SAMPLE_CHARACTERS = 2_000_000
#: Chosen ids that are sent to every task, at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Of these, one in so many calibrates instead.
CALIBRATION = 5
#: Characters scored at a time.
BLOCK = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(x).isalpha() for x in range(0x110000)]))
    return _letters[0]


def characters(text: str | None) -> np.ndarray:
    """The text's letters in lower case as code points, other runs as one space, with spaces around; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    spaced = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    spaced = spaced[keep]
    space = np.full(1, 32, np.uint64)
    return np.concatenate((space, spaced, space if spaced[-1] != 32 else spaced[:0]))


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 .. order, a hash of the n characters up to each one, as if spaces came before."""
    padded = np.concatenate((np.full(order, 32, np.uint64), points))
    out = [np.zeros(len(points), np.uint64)]
    with np.errstate(over="ignore"):
        code = np.zeros(len(points), np.uint64)
        for n in range(1, order + 1):
            at = order - n + 1
            code = code + (padded[at : at + len(points)] + np.uint64(1)) * MULTIPLIER ** np.uint64(n)
            out.append(code ^ (code >> np.uint64(31)))
    return out


@dataclass
class Grams:
    """One order of all models: sorted n-gram hashes with log probabilities, sorted context hashes with log back-off weights."""

    keys: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_weight: np.ndarray


def find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the asked hashes in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Model:
    languages: list[str]
    orders: list[Grams]
    log_base: float
    temperature: float = 1.0
    ceiling: np.ndarray | None = None

    def entropies(self, text: str | None) -> np.ndarray | None:
        """Cross-entropy per character in each language; None for a text without letters."""
        points = characters(text)
        if not len(points) or not self.languages:
            return None
        total, order = np.zeros(len(self.languages)), len(self.orders)
        for at in range(1, len(points), BLOCK):
            lead = min(at, order)
            part = points[at - lead : at + BLOCK]
            total += self._log_likelihood(part, lead)
        return -total / (len(points) - 1)

    def _log_likelihood(self, points: np.ndarray, lead: int) -> np.ndarray:
        hashes = gram_hashes(points, len(self.orders))
        total, pending = np.zeros(len(self.languages)), np.arange(lead, len(points))
        for n in range(len(self.orders), 0, -1):
            grams = self.orders[n - 1]
            at, known = find(grams.keys, hashes[n][pending])
            total += np.bincount(at[known], minlength=len(grams.keys)) @ grams.log_p if known.sum() > len(grams.keys) else grams.log_p[at[known]].sum(0)
            pending = pending[~known]
            if not len(pending):
                return total
            at, known = find(grams.contexts, hashes[n - 1][pending - 1])
            total += grams.log_weight[at[known]].sum(0)
        return total + len(pending) * self.log_base

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is close enough to that language."""
        entropies = self.entropies(text)
        if entropies is None:
            return UNKNOWN, 0.0, False
        best = int(np.argmin(entropies))
        share = 1.0 / float(np.exp((entropies[best] - entropies) * self.temperature).sum())
        over = 0.0 if self.ceiling is None else max(0.0, float(entropies[best] - self.ceiling[best]))
        return self.languages[best], min(1.0, share * float(np.exp(-over))), over == 0.0


def learn(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    """Kneser-Ney models of the given texts by language."""
    languages = sorted(texts)
    points = {language: [p for text in texts[language] if len(p := characters(text))] for language in languages}
    alphabet = np.unique(np.concatenate([p for ps in points.values() for p in ps] or [np.zeros(0, np.uint64)]))
    base = 1.0 / (len(alphabet) + 1)
    # Distinct (context, last character) pairs of each order and language, with counts: raw at
    # the top, below it the number of different characters that come before.
    tables: list[list[tuple]] = [[] for _ in range(order)]
    for language in languages:
        streams = [(gram_hashes(p, order + 1), p) for p in points[language]]
        for n in range(1, order + 1):
            grams, shorter, wider = (np.concatenate([s[k][1:] for s, _ in streams] or [np.zeros(0, np.uint64)]) for k in (n, n - 1, n + 1))
            context = np.concatenate([s[n - 1][:-1] for s, _ in streams] or [np.zeros(0, np.uint64)])
            if n < order:
                _, first = np.unique(wider, return_index=True)
                grams, shorter, context = grams[first], shorter[first], context[first]
            keys, first, counts = np.unique(grams, return_index=True, return_counts=True)
            tables[n - 1].append((keys, shorter[first], context[first], counts))
    # ``shorter`` is the gram without its first character, whose probability interpolates.
    orders: list[Grams] = []
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([t[0] for t in tables[n - 1]])) if tables[n - 1] else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([t[2] for t in tables[n - 1]])) if tables[n - 1] else np.zeros(0, np.uint64)
        p, weight = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        below, of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for k, (own, shorter, context, counts) in enumerate(tables[n - 1]):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at, where = np.searchsorted(keys, own), np.searchsorted(contexts, context)
            sums = np.bincount(where, counts, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            seen = sums > 0
            weight[seen, k] = discount * kinds[seen] / sums[seen]
            p[at, k] = (counts - discount) / sums[where]
            below[at], of[at] = shorter, context
        rest = np.full((len(keys), len(languages)), base)
        if n > 1:
            # Each shorter gram was counted, in some language, one order below.
            rest = np.exp(orders[-1].log_p[np.searchsorted(orders[-1].keys, below)])
        p += weight[np.searchsorted(contexts, of)] * rest if len(keys) else 0
        orders.append(Grams(keys, np.log(p), contexts, np.log(weight)))
    return Model(languages, orders, float(np.log(base)))


def calibrate(model: Model, texts: dict[str, list[str]], deviations: float = 4.0) -> Model:
    """``model`` with the temperature of the least log loss, and each language's highest accepted entropy."""
    rows, ceiling = [], np.full(len(model.languages), np.inf)
    for k, language in enumerate(model.languages):
        found = [e for text in texts.get(language, []) if (e := model.entropies(text)) is not None]
        rows += [(k, e) for e in found]
        own = np.array([e[k] for e in found])
        if len(own) > 1:
            ceiling[k] = own.mean() + deviations * max(own.std(), 0.02)
    if rows:
        truth, gaps = np.array([k for k, _ in rows]), np.array([e for _, e in rows])
        losses = {}
        for temperature in 2.0 ** np.arange(-2, 8):
            logits = -gaps * temperature
            logits -= logits.max(1, keepdims=True)
            losses[temperature] = float((np.log(np.exp(logits).sum(1)) - logits[np.arange(len(truth)), truth]).mean())
        model.temperature = float(min(losses, key=losses.get))
    model.ceiling = ceiling
    return model


def training_rows(df: DataFrame, trains: Column, documents: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Of each language, ``documents`` rows at most (lang, rank, text): those with the lowest hash of id and text.

    A language's count of different rows tells below which hash about four times as many lie; only
    their ids and hashes are ranked, and the texts come by a join with the chosen ones. Rows that are equal in id and text
    are ranked as one with its number of copies, other rows of one id each for itself.
    """
    named = df.where(trains).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = named.where("_id is not null and lang is not null and text is not null").withColumn("_hash", F.xxhash64("_id", "text"))
    counts = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).collect()}
    if not counts:
        return usable.select("lang", F.lit(0).alias("rank"), "text")
    highest = {lang: (int(min(1.0, 4 * documents / n) * (1 << 53)) << 11) - (1 << 63) - 1 for lang, n in counts.items()}
    limits = F.create_map(*(F.lit(x) for item in highest.items() for x in item))
    order = Window.partitionBy("lang").orderBy("_hash", "_id")
    few = usable.where(F.col("_hash") <= F.try_element_at(limits, F.col("lang"))).groupBy("_id", "lang", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    before = F.coalesce(F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = few.withColumns({"rank": F.row_number().over(order), "_copies": F.least(F.col("_copies"), documents - before)}).where(F.col("_copies") > 0)
    chosen = ranked.select(F.col("_id").alias("_chosen"), F.col("lang").alias("_lang"), F.col("_hash").alias("_found"), "rank", "_copies")
    # At most ``documents`` rows a language: few enough to send to every task, unless languages abound.
    chosen = F.broadcast(chosen) if documents * len(counts) <= BROADCAST_ROWS else chosen
    met = usable.join(chosen, (F.col("_id") == F.col("_chosen")) & (F.col("lang") == F.col("_lang")) & (F.col("_hash") == F.col("_found")))
    texts = met.groupBy("lang", "rank", "_copies").agg(F.min("text").alias("text"))
    return texts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("lang", "rank", "text")


def train(df: DataFrame, trains: Column, documents: int = SAMPLE_DOCUMENTS, characters_at_most: int = SAMPLE_CHARACTERS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A calibrated model from the rows where ``trains`` holds.

    ``documents`` and ``characters_at_most`` bound, per language, the labelled
    sample that is gathered to learn from, whatever the table's size: rows are taken
    while those before them have fewer characters, and those with over a tenth of the
    bound come last. So a language is learned even if all its rows are longer than that.
    """
    sample = training_rows(df, trains, documents, id_col, text_col, lang_col)
    before = Window.partitionBy("lang").orderBy(F.length("text") * 10 > characters_at_most, "rank", "text").rowsBetween(Window.unboundedPreceding, -1)
    bounded = sample.withColumn("_before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("_before") < characters_at_most)
    learned: dict[str, list[str]] = {}
    left_out: dict[str, list[str]] = {}
    for row in bounded.orderBy("lang", "rank", "text").collect():
        (left_out if row["rank"] % CALIBRATION == 0 else learned).setdefault(row["lang"], []).append(row["text"])
    return calibrate(learn(learned, order), left_out)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Per row: its id, the columns to ``carry`` along, lang_pred, score and accepted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = [df.schema[name].dataType.simpleString() for name in (id_col, *carry)]
    names = ["id", *(f"_carried_{k}" for k in range(len(carry)))]

    def start():
        predict = shared.value.predict
        return lambda key, text, *others: [(key, *others, *predict(text))]

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds)) + ", lang_pred string, score double, accepted boolean"
    return map_rows(df.select(F.col(id_col), F.col(text_col), *carry), schema, start).withColumnsRenamed(dict(zip(names, (id_col, *carry))))
