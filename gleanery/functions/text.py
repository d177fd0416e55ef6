"""Text functions as columns.

Java's classes are narrower than Unicode's: words are spelled as ``[\\p{L}\\p{N}_]``
and white space carries the flag (?U) and the four separators U+001C to U+001F.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\u001f"
SPACE = r"[\s\x1c-\x1f]"
#: The characters of SPACE with the flag (?U).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]"
#: Words that keyword queries leave out.
STOP_WORDS = (
    "a", "an", "and", "are", "be", "been", "being", "can", "could", "did", "do", "does", "for", "from", "how", "in", "is", "may", "might", "of", "on", "or",
    "the", "to", "was", "were", "what", "when", "where", "which", "who", "whom", "why", "will", "with", "would",
)
TERM_CHARACTERS = r"[\p{L}\p{N}_+#]+"
TERM = rf"{TERM_CHARACTERS}(?:[./:\-]{TERM_CHARACTERS})*"
TOKEN = rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
RARE_BREAK = r"[\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Parts a sentence split can be told from in both engines: a mark, then white space.
SENTENCE_BREAK = rf"(?U)(?<=[.!?;:]){SPACE}+"


def normal_form(text: str) -> str:
    """NFKC, case folding, and runs of white space as one space, of one text; columns have ``text_identity``."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def fold(text: Column) -> Column:
    """Case-folded, by the built-in mappings: capitals of capitals' small letters, with one small sigma. Only Cherokee, the dotless i, the capital sharp s and letters newer than Python's tables fold otherwise."""
    # Spark takes the lower case of the upper case for the lower case alone, unless something stands between.
    return F.lower(F.translate(F.upper(text), "Σ", "σ"))


def trim(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


@F.pandas_udf(T.StringType())
def text_identity(texts):
    """The query normal form of a column, exactly; NFKC has no built-in."""
    return texts.map(normal_form, na_action="ignore")


def terms(normalized: Column) -> Column:
    """Distinct query terms of a normalised column, in order, without stop words."""
    return F.array_except(F.regexp_extract_all(normalized, F.lit(TERM), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


def token_count(text: Column) -> Column:
    """Words plus single punctuation characters."""
    return F.regexp_count(text, F.lit(f"(?U){TOKEN}")).cast("long")


def sentences(text: Column) -> Column:
    """Sentences, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(text, SENTENCE_BREAK), trim), lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines as Python's splitlines cuts them: a last break ends a line and begins none."""
    # Most texts have one kind of break, at which they are cut faster.
    cut = F.when(text.rlike(RARE_BREAK), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    # Bound by a lambda, so that a text is cut once.
    whole = F.get(F.transform(F.array(cut), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def sha256(*parts: Column) -> Column:
    """SHA-256 of the parts joined by U+001F; null parts count as empty, as concat_ws would drop them."""
    return F.sha2(F.concat_ws(UNIT, *(F.coalesce(part.cast("string"), F.lit("")) for part in parts)), 256)


def bounded_term(column: Column, term: str) -> Column:
    """Whether a lower-cased column has the term between ends or characters other than ASCII letters, digits and _."""
    escaped = re.sub(r"([^\w\s])", r"\\\1", term)
    # The plain search turns most texts away.
    return column.contains(term) & F.regexp_like(column, F.lit(rf"(?:^|[^A-Za-z0-9_]){escaped}(?:[^A-Za-z0-9_]|$)"))


def json_path(path: Column) -> Column:
    """A path as compact JSON, which is what keyword search reads."""
    return F.to_json(path)


def format_score(score: Column) -> Column:
    """Six significant digits, or a dash."""
    return F.coalesce(F.format_string("%.6g", score), F.lit("—"))
