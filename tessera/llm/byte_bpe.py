"""Byte-level BPE through a sentencepiece model that is serialised straight from a vocabulary.

Every byte has a printable stand-in character; a vocabulary entry becomes the piece made of its bytes'
stand-ins, scored by its negative rank, so that sentencepiece's best-score-first merges are the
lowest-rank-first merges of byte-level BPE. Pre-tokens are cut by a pattern and encoded one by one.

Defined cases: a null or empty text has no ids and decodes to no bytes; any other Unicode text is encoded
whole and decodes to its exact UTF-8 bytes; repeated rows are encoded alike; an empty table gives an empty
table; the columns that are added replace input columns of the same name.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches_by_bytes, release_memory

CACHE_ENTRIES = 200_000
LONG_TEXT = 1_000_000
OUT_BYTES = 16 << 20
GROUP = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def stand_ins() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _blob(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & 0xFFFFFFFFFFFFFFFF)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model (a protocol buffer) of a BPE vocabulary in rank order; id = rank, the unknown piece last."""
    chars, out = stand_ins(), bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _blob(1, _blob(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1))
    out += _blob(1, _blob(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normaliser = _blob(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out + _blob(2, trainer) + _blob(3, normaliser))


def fast_pattern(pattern: str):
    """The pattern for the standard library's engine, right for texts of the basic plane: classes become ranges of it."""
    import re

    import regex

    plane = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x01" for c in range(0x10000))
    held = {k: "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in regex.finditer(k + "+", plane)) for k in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside, at = "", False, 0
    while at < len(pattern):
        token = next((k for k in held if pattern.startswith(k, at)), pattern[at : at + 2] if pattern[at] == "\\" else pattern[at])
        out += (held[token] if inside else f"[{held[token]}]") if token in held else token
        inside, at = token == "[" or (inside and token != "]"), at + len(token)
    return re.compile(out)


class Codec:
    """Encodes texts to ids and ids to bytes in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex

        order = sorted(ranks, key=ranks.__getitem__)
        self.pattern, self.fast = regex.compile(pattern), fast_pattern(pattern)
        self.ranks, self.to_rank = ranks, [ranks[t] for t in order]
        self.numbers = np.array([*self.to_rank, 0], "<u4")
        #: Byte 255 is in no UTF-8 text and separates pre-tokens here.
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(stand_ins()[:255])} | {"\xff": "\n"})
        self.model = self._load(model or serialise(order))
        back = {c: b for b, c in enumerate(stand_ins())}
        bytes_of = {self.to_rank[i]: bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(order))}
        top = max(bytes_of, default=-1) + 1
        self.lengths = np.array([len(bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _load(proto: bytes):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=proto)

    def pieces(self, words) -> None:
        """Puts the ids of pre-tokens into the cache, as little-endian unsigned 32-bit integers."""
        rest = []
        for word in words:
            if (whole := self.ranks.get(word.encode())) is not None:
                self.cache[word] = struct.pack("<I", whole)
            else:
                rest.append(word)
        # Hundreds of pre-tokens go through one call, kept apart by a character that is no piece: no merge crosses it.
        for at in range(0, len(rest), GROUP):
            group = rest[at : at + GROUP]
            text = b"\xff".join(w.encode() for w in group).decode("latin-1").translate(self.chars)
            ids = np.array(self.model.encode(text), np.int64)
            ends = [*np.flatnonzero(ids == len(self.to_rank)).tolist(), len(ids)]
            raw, start = self.numbers[ids].tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self.cache[word] = raw[4 * start : 4 * end]
                start = end + 1

    def words(self, text: str):
        """Lists of the pre-tokens of a text, one after the other; a long text comes in several."""
        pattern = self.fast if len(text.encode("utf-16-le")) == 2 * len(text) else self.pattern
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while part := list(islice(found, 100_000)):
            yield part

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pre-tokens that aren't in the cache are encoded together."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        out, held, size = [b""] * len(texts), [], 0

        def flush():
            new = set().union(*(part for _, part in held)) - self.cache.keys()
            self.pieces(new)
            for i, part in held:
                out[i] += b"".join(map(self.cache.__getitem__, part))
            for word in new:
                if len(word) > 64:
                    del self.cache[word]
            held.clear()

        for i, text in enumerate(texts):
            for part in self.words(text):
                held.append((i, part))
                size += len(part)
                if size > 1_000_000:
                    flush()
                    size = 0
        flush()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        out = []
        for at in range(0, len(ids), 4 << 20):
            part = np.frombuffer(ids[at : at + (4 << 20)], "<u4")
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            out.append(self.flat[np.repeat(self.starts[part] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@lru_cache(2)
def _codec(model: bytes, vocabulary: tuple[bytes, ...], numbers: tuple[int, ...], pattern: str) -> Codec:
    return Codec(dict(zip(vocabulary, numbers, strict=True)), pattern, model)


def _mapped(df: DataFrame, ranks: dict[bytes, int], pattern: str, source: str, made: dict[str, T.DataType], work) -> DataFrame:
    kept = [c for c in df.columns if c not in made]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, v) for k, v in made.items())])
    arrow = {"long": pa.int64(), "binary": pa.binary()}
    kinds = [arrow["long" if isinstance(v, T.LongType) else "binary"] for v in made.values()]

    order = sorted(ranks, key=ranks.__getitem__)
    held = df.sparkSession.sparkContext.broadcast((serialise(order), tuple(order), tuple(ranks[t] for t in order), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*held.value)
        try:
            for part in batches_by_bytes(batches, source, OUT_BYTES // 4):
                cols = [pa.array(c, k) for c, k in zip(work(codec, part.column(source).to_pylist()), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *made])
        finally:
            codec.cache.clear()
            release_memory()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every whole text."""

    def work(codec: Codec, texts: list[str | None]):
        ids = codec.encode_all([t or "" for t in texts])
        return [len(x) // 4 for x in ids], ids

    return _mapped(df, ranks, pattern, text_col, {"n_tokens": T.LongType(), "ids": T.BinaryType()}, work)


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes that the ids stand for. Null ids decode to no bytes."""

    def work(codec: Codec, ids: list[bytes | None]):
        return ([codec.decode(x or b"") for x in ids],)

    return _mapped(df, ranks, r"\S+", ids_col, {"decoded": T.BinaryType()}, work)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: ``n_tokens``, ``ids`` and, decoded from the ids, ``decoded``."""

    def work(codec: Codec, texts: list[str | None]):
        ids = codec.encode_all([t or "" for t in texts])
        return [len(x) // 4 for x in ids], ids, [codec.decode(x) for x in ids]

    return _mapped(df, ranks, pattern, text_col, {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.BinaryType()}, work)
