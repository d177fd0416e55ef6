"""Line-first quality rules.

Each line is judged on its own: does it hold sentences, is it a row of navigation, is it boilerplate (symbols for words, shouting, one word over and
over, a site's standing phrase, a line that the document has repeated). Lines that fail are removed; a
document that loses too much of its text that way is rejected. Base counts, which
do not depend on lines, reject short and repetitive documents first.

Edge cases: a null text counts as empty, has no words and is rejected; blank lines
are neither judged nor lost; whole texts are read, however long; repeated rows are
judged one by one; an empty table gives an empty result; columns other than the
two named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import map_rows

BLANKS = " \t\n\v\f\r"
SYMBOLS = b"[#*$%&|<>]"
#: What sentences end with, in Latin, Greek, Cyrillic, Armenian, Arabic, Urdu, Indic, Burmese, Khmer, Ethiopic, Tibetan and CJK writing.
STOPS = ".!?…։؟۔।॥။៕።།。！？｡"
ENDINGS = (*STOPS, ":", ";", "؛", "：", "；")
CLOSERS = "\"'”’»)]」』）"
INNER_END = re.compile(rf"[{re.escape(STOPS)}][{re.escape(CLOSERS)}]*\s|[。！？]")
#: Phrases of short lines that sites repeat on every page.
PHRASES = re.compile(
    r"(?i)\b(?:accept (?:all )?cookies|we use cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|all rights reserved|subscribe to our|sign up for our"
    r"|click here to|enable javascript|share on (?:facebook|twitter)|leave a comment|log in to|skip to (?:main )?content|back to top|lorem ipsum)\b"
)
NAVIGATION = {"|", "»", "›", "•", "·", ">", "/", "→"}
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of a line's words, ``max_lost`` of a document's word characters."""

    min_words: int = 20
    max_repeated: float = 0.3
    max_navigation: float = 0.15
    max_symbols: float = 0.3
    max_shouted: float = 0.5
    min_shouted_words: int = 4
    max_stuttered: float = 0.3
    max_copies: int = 2
    max_phrase_words: int = 12
    words_a_sentence: int = 100
    max_lost: float = 0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(word, len(known)) for word in words], np.uint64)
    if len(known) > len(words) - window:
        return 0
    with np.errstate(over="ignore"):
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        code = np.zeros(n, np.uint64)
        for k in range(window):
            code = code * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.sort(code)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Windows with equal codes are told apart exactly, by ranks of pairs, of fours, of eights.
    ranks, span = ids, 1
    while span < window:
        step = min(span, window - span)
        pairs = np.stack((ranks[:-step], ranks[step:]), axis=1)
        ranks, span = np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64), span + step
    _, inverse, counts = np.unique(ranks, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse.reshape(-1)] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def line_fails(line: str, rules: Rules) -> str | None:
    """The rule that a line with a word breaks, if any."""
    words = line.split()
    if not words:
        return None
    n = len(words)
    if sum(word in NAVIGATION for word in words) > rules.max_navigation * n:
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > rules.max_symbols * n and n > 1:
        return "boilerplate"
    if n >= rules.min_shouted_words and sum(map(str.isupper, words)) > rules.max_shouted * n:
        return "boilerplate"
    if n <= rules.max_phrase_words and PHRASES.search(line):
        return "boilerplate"
    if n > 3 and sum(map(str.__eq__, words, words[1:])) > rules.max_stuttered * n:
        return "boilerplate"
    if not line.rstrip().rstrip(CLOSERS).endswith(ENDINGS) and len(INNER_END.findall(line)) * rules.words_a_sentence < n:
        return "punctuation"
    return None


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """Base counts, verdicts and the cleaned text of one document."""
    text = text or ""
    data = text.encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=128) if data else np.zeros(128, np.int64)
    n_words = len(words)
    word_chars = len(text) - int(sum(counts[ord(x)] for x in BLANKS))
    n_symbols = int(sum(counts[x] for x in SYMBOLS[1:-1]))
    n_repeat = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * n_repeat > round(100 * rules.max_repeated) * n_words

    seen: dict[str, int] = {}
    kept, n_dup, lost, total, broken = [], 0, 0, 0, {"navigation": 0, "boilerplate": 0, "punctuation": 0}
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        if not bare:
            kept.append(line)
            continue
        copies = seen[line] = seen.get(line, 0) + 1
        n_dup += copies > 1
        total += len(bare)
        rule = "boilerplate" if copies > rules.max_copies else line_fails(bare, rules)
        if rule:
            broken[rule] += 1
            lost += len(bare)
        else:
            kept.append(line)
    passed = not base_failed and lost <= rules.max_lost * total
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, passed, broken["navigation"], broken["boilerplate"], broken["punctuation"], lost / total if total else 0.0, "\n".join(kept))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, navigation_lines long, boilerplate_lines long, unpunctuated_lines long, lost_share double"


def quality_rules(df: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Per row: its id, the counts and verdicts and, if asked for, the cleaned text, and the columns to ``carry`` along."""
    kinds = [df.schema[name].dataType.simpleString() for name in (id_col, *carry)]
    names = ["id", *(f"_carried_{k}" for k in range(len(carry)))]

    def start():
        def one(key, text, *others):
            found = judge(text, rules)
            return [(key, *others, *(found if with_text else found[:-1]))]

        return one

    schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds)) + f", {COLUMNS}" + ", clean_text string" * with_text
    judged = map_rows(df.select(F.col(id_col), F.col(text_col), *carry), schema, start)
    return judged.withColumnsRenamed(dict(zip(names, (id_col, *carry))))
