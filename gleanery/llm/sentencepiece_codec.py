"""SentencePiece encoding with byte spans, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character
map while the source byte of every normalised byte is kept. The pieces of the
normalised text are then projected through that alignment to spans of the
original UTF-8 bytes. Decoding goes from ids alone.

Edge cases: a null text counts as empty; an empty text has no pieces and decodes
to an empty text; texts of any length are encoded whole; repeated rows are encoded
one by one; an empty table gives an empty result; columns other than the two named
are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Remembered, map_rows

SPACE = "▁"
#: Words whose pieces a worker remembers, in each of two generations.
CACHE_UNITS = 120_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and raw value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Normalizer:
    """The compiled character map of a model, with source alignment.

    The map is a double-array trie followed by the NUL-ended replacements it
    points to. At each position the longest key of the trie that is a prefix of
    the rest is replaced; without one, a single character is kept.
    """

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        charsmap = fields.get(2, b"")
        self.dummy_prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.escape = bool(fields.get(5, 1))
        self.units: tuple[int, ...] = ()
        self.replacements = b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.replacements = charsmap[4 + size :]
        self.plain = not self.units and self.dummy_prefix and self.escape and not self.squeeze

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Bytes of the longest key at ``at`` and where its replacement begins; (0, 0) for none."""
        units = self.units
        found = (0, 0)
        if not units:
            return found
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if (unit >> 8) & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end its source byte."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        return self._plain(data) if self.plain else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE.encode()
        source = np.frombuffer(data, np.uint8)
        widths = np.where(source == 32, 3, 1)
        align = np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]))
        return space + data.replace(b" ", space), align

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            size, offset = self.longest(data, at)
            if size:
                piece = self.replacements[offset : self.replacements.index(b"\0", offset)]
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = data[at : at + size]
            parts.append((piece, at))
            at += size
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        out, align = bytearray(), []
        space = SPACE.encode() if self.escape else b" "
        if self.dummy_prefix and parts:
            out += space
            align += [parts[0][1]] * len(space)
        last_space = self.squeeze
        for piece, source in parts:
            if self.squeeze and last_space:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            last_space = piece.endswith(b" ")
            piece = piece.replace(b" ", space)
            out += piece
            align += [source] * len(piece)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), np.array([*align, len(data)], np.int64)


class Codec:
    """Encodes and decodes with one model, given as the bytes of its file."""

    def __init__(self, model: bytes, cache_units: int = CACHE_UNITS):
        import sentencepiece

        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces, spec = [], b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b""), piece.get(3, 1)))
            elif number == 3:
                spec = value
        self.normalizer = Normalizer(spec)
        space = SPACE.encode()
        #: What a piece adds to a decoded text; type 2 is unknown, 3 is control, 6 a single byte.
        self.surface = [b" \xe2\x81\x87 " if kind == 2 else b"" if kind == 3 else bytes([int(piece[3:5], 16)]) if kind == 6 else piece.replace(space, b" ") for piece, kind in pieces]
        self.widths = np.array([1 if kind == 6 else len(piece) for piece, kind in pieces], np.int64)
        self.unknown = np.array([kind == 2 for _, kind in pieces])
        # No piece runs over the start of a word that one space precedes, so such words are encoded apart.
        inside = any(space in piece.lstrip(b"\xe2\x96\x81") for piece, _ in pieces)
        self.by_word = self.normalizer.plain and not inside
        self.begins_word = np.array([piece.startswith(space) for piece, _ in pieces])
        self.words = Remembered(self._learn, cache_units)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text's pieces."""
        if not text:
            return np.zeros(0, np.int32)
        # A literal U+2581 is a space to the model, and pieces join neighbouring spaces.
        if not self.by_word or "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            return np.array(self.engine.encode(text), np.int32)
        return np.frombuffer(b"".join(self.words(text.split(" "))), np.int32)

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one text of them all: a word's first piece, and no other, begins with a space."""
        ids = np.array(self.engine.encode(" ".join(words)), np.int32)
        starts = (4 * np.flatnonzero(self.begins_word[ids])).tolist()
        if len(starts) != len(words):
            raise ValueError("words do not begin with a space's piece")
        data = ids.tobytes()
        return [data[begin:end] for begin, end in zip(starts, [*starts[1:], len(data)])]

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte, and byte after the last, of each piece in the text's UTF-8 bytes."""
        normalized, align = self.normalizer.normalize(text)
        widths = self.widths[ids]
        if self.unknown[ids].any():
            widths = self._unknown_widths(normalized, ids)
        ends = np.cumsum(widths)
        if (ends[-1] if len(ends) else 0) != len(normalized):
            raise ValueError("pieces do not cover the normalised text")
        return align[ends - widths], align[ends]

    def _unknown_widths(self, normalized: bytes, ids: np.ndarray) -> np.ndarray:
        """Piece widths where unknown pieces stand for the characters between known ones."""
        widths, at = self.widths[ids].copy(), 0
        space = SPACE.encode()
        for k, unknown in enumerate(self.unknown[ids]):
            if unknown:
                following = next((self.surface[i].replace(b" ", space) for i in ids[k + 1 : k + 2]), None)
                stop = len(normalized) if following is None else normalized.index(following, at + 1)
                widths[k] = stop - at
            at += widths[k]
        return widths

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids spell."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.normalizer.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", errors="replace")


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    """One codec for each model in a worker process; workers are reused across tasks."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


SCHEMA = "id {id}, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode_documents(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, the ids of its pieces, their byte spans and the decoded text.

    ``model`` is the content of a SentencePiece model file (a bounded size, sent
    to the executors once).
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        codec = _codec(shared.value)

        def one(key, text):
            text = text or ""
            ids = codec.encode(text)
            begins, ends = codec.spans(text, ids)
            return [(key, ids, begins, ends, codec.decode(ids))]

        return one

    return map_rows(df.select(F.col(id_col), F.col(text_col)), SCHEMA.format(id=kind), start, output_rows=500).withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encoded rows; spans_hash is of all spans, spans_cover tells whether they begin at 0 and end at span_bytes without a gap."""
    gapless = F.slice("begins", F.lit(2), F.size("begins")) == F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))
    whole = (F.size("ids") == 0) | ((F.get("begins", F.lit(0)) == 0) & gapless)
    return encoded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
        whole.alias("spans_cover"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("span_bytes"),
    )
