"""Substring dedup by sliding spans of sentences.

A text is cut into sentences (ended by ``.``, ``!``, ``?`` before a space, by the full stops of scripts that set none, or by a line break). One longer than ``UNIT_WORDS`` words is
cut by its content: behind the word of smallest hash (all of them, if several are equal) of every ``WINDOW`` words in
a row, so that its parts have ``WINDOW`` words at most and a passage is cut alike wherever it stands but for
``WINDOW - 1`` words at either end. From every sentence on, the shortest run of ``min_sentences`` or more sentences that has ``min_words`` words
is hashed to 128 bits. So a verbatim passage within long sentences shares a run from ``min_words + 3 * WINDOW - 2``
words on (50 as set), at any offset; what is left of it are ends of less than ``2 * WINDOW`` words. A passage whose ends lie in sentences of ``UNIT_WORDS`` or less
loses up to ``UNIT_WORDS - 1`` words there, as those are only compared whole.
Texts are cut and hashed once, into a written table of runs and of each text's sentence lengths, by which sentences are
taken out later. Runs are joined globally: halves of their hashes tell which may
repeat, and only those are looked at further. A sentence goes if a run that holds it stands at an earlier place
(by document id, then text hash, then sentence) too.

Defined cases: a null text stays null; empty and short texts stay as they are; null ids come first in the order of
places; rows that repeat id and text are one document and are all changed alike; an empty table gives an empty
table; the columns added replace input columns of the same name; a document all of whose sentences go has an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, free, mix64, row_key, written

UNIT_WORDS, WINDOW = 16, 9
#: The table of repeated runs' slots has 2**27 bits (16 MB) at most.
MAX_SLOTS = 27
#: Any would do; with this one the 18-word sentence of the tests has two parts, as it had before.
SEED = 70
_SENTENCE = re.compile(r"\s*(?:\S*[^\s.!?][^\S\n]+)*\S+\s*")
_WORD = re.compile(r"\s*\S+\s*")
#: Sentence ends that no space follows, and scripts that put no spaces between words (a letter counts as a word there).
_STOP = re.compile(r"(?<=[。！？｡।॥۔؟])(?=[^\s。！？｡।॥۔؟])")
_CLOSE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0002fa1f"
_HAS_CLOSE = re.compile(f"[{_CLOSE}]")
_CLOSE_WORD = re.compile(rf"\s*(?:[{_CLOSE}]|[^\s{_CLOSE}]+)\s*")


def words_of(text: str) -> list[str]:
    """The words with the white space around them: joined, they are the text (unless it is blank)."""
    return (_CLOSE_WORD if _HAS_CLOSE.search(text) else _WORD).findall(text)


class _WordHashes(dict):
    """Hashes of words; frequent ones are looked up."""

    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word, SEED)
        if len(word) <= 64:
            if len(self) >= 1 << 18:
                self.clear()
            self[word] = found
        return found


_hashes = _WordHashes()


def cuts(words: list[str], owner: np.ndarray) -> np.ndarray:
    """Whether a cut comes behind each word; ``owner`` is the number of its sentence, of ``WINDOW`` words or more."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    least = h[:n]
    for k in range(1, WINDOW):
        least = np.minimum(least, h[k : n + k])
    least = np.where(owner[:n] == owner[WINDOW - 1 :], least, 0)
    # the least of a window is as great as the greatest of the windows' leasts around it
    around = np.zeros(len(h), np.uint64)
    for k in range(WINDOW):
        np.maximum(around[k : n + k], least, out=around[k : n + k])
    return around == h


def ends(text: str) -> np.ndarray:
    """The places in the text where its sentences end, white space behind them included; none if it is blank."""
    whole, least, close = _SENTENCE.findall(text), 2 * UNIT_WORDS, False
    if not text.isascii():
        whole, least, close = [p for s in whole for p in _STOP.split(s)], UNIT_WORDS, bool(_HAS_CLOSE.search(text))
    if close:
        split = {k: [x.strip() for x in w] for k, s in enumerate(whole) if len(s) > least and len(w := words_of(s)) > UNIT_WORDS}
    else:
        split = {k: w for k, s in enumerate(whole) if len(s) > least and len(w := s.split()) > UNIT_WORDS}
    stop = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
    if not split:
        return stop
    which, words = np.fromiter(split, np.int64, len(split)), [x for w in split.values() for x in w]
    size = np.fromiter(map(len, split.values()), np.int64, len(split))
    last, lead = np.cumsum(size) - 1, np.array([len(s) - len(s.lstrip()) for s in map(whole.__getitem__, split)])
    behind = cuts(words, np.repeat(np.arange(len(size)), size))
    # right where one character of white space parts all words of a sentence; those of others are measured
    width = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = stop[which] - np.fromiter((len(whole[k]) for k in split), np.int64, len(split))
    at = width + np.repeat(begin + lead - np.concatenate([[0], width[last[:-1]]]), size)
    for i in np.flatnonzero(close | (at[last] - 1 != begin + [len(whole[k].rstrip()) for k in split])).tolist():
        at[last[i] + 1 - size[i] : last[i] + 1] = begin[i] + np.cumsum([len(w) for w in words_of(whole[which[i]])])
    behind[last] = False
    return np.sort(np.concatenate([stop, at[behind]]))


def sentences(text: str) -> list[str]:
    """The sentences with the white space around them: joined, they are the text (unless it is blank)."""
    return pieces_of(text, ends(text))


def pieces_of(text: str, stop: np.ndarray) -> list[str]:
    stops = stop.tolist()
    return [text[a:b] for a, b in zip([0, *stops], stops)]


def packed(stop: np.ndarray) -> bytes:
    """The lengths of the sentences in as few bytes each as the longest one takes; see ``unpacked``."""
    size = np.diff(stop, prepend=0)
    return size.astype(np.min_scalar_type(int(size.max(initial=0))).newbyteorder("<")).tobytes()


def unpacked(sizes: bytes, n: int) -> np.ndarray:
    """The ``n`` + 1 places where sentences begin or end."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(sizes, f"<u{len(sizes) // n}"), dtype=np.int64)])


def runs(units: list[str], min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of each run, and two 64-bit hashes of it."""
    import xxhash

    n = len(units)
    whole = [u.strip() for u in units]
    words = [words_of(u) for u in whole] if _HAS_CLOSE.search("".join(whole)) else map(str.split, whole)
    counts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n))])
    start = np.arange(n)
    end = np.maximum(np.searchsorted(counts, counts[:-1] + min_words), start + min_sentences)
    start = start[end <= n]
    end = end[: len(start)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, whole), np.uint64, n)
    # a polynomial in an odd base over the sentences' hashes, told apart by how long the run is
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        inverse = pow(base, -1, 1 << 64)
        power = np.cumprod(np.array([1, *[base] * n], np.uint64))
        back = np.cumprod(np.array([1, *[inverse] * n], np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(base)) * power[:-1])])
        out.append(mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64))
    return start, end - 1, *out


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 3, min_words: int = 25) -> DataFrame:
    """``_k1, _k2, start, stop, h1, h2`` of every run of sentences (``stop`` included), and a row a text: ``stop`` is the
    number of its sentences and ``sizes`` their ``packed`` lengths, null in other rows; ``start``, ``h1`` and ``h2`` are null."""
    schema = "_k1 long, _k2 long, start int, stop int, h1 long, h2 long, sizes binary"
    names, kinds = ["_k1", "_k2", "start", "stop", "h1", "h2"], [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, "t", 2 << 20):
            k1, k2, rows, n, sizes = part.column("_k1").to_numpy(), part.column("_k2").to_numpy(), [], [], []
            for i, text in enumerate(part.column("t").to_pylist()):
                stop = ends(text or "")
                n.append(len(stop))
                sizes.append(packed(stop))
                if len(stop) >= min_sentences:
                    start, last, h1, h2 = runs(pieces_of(text, stop), min_sentences, min_words)
                    rows.append((np.full(len(start), k1[i]), np.full(len(start), k2[i]), start.astype(np.int32), last.astype(np.int32), h1, h2))
            none = [pa.nulls(len(n), k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part.column("_k1"), part.column("_k2"), none[2], pa.array(n, pa.int32()), *none[4:], pa.array(sizes, pa.binary())], names=[*names, "sizes"])
            if rows:
                cols = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.binary())], names=[*names, "sizes"])

    return row_key(df, id_col, text_col).select("_k1", "_k2", F.col(text_col).alias("t")).mapInArrow(run, schema)


def possibly_repeated(found: DataFrame) -> DataFrame:
    """The runs that stand at several places, and a few others.

    First halves of hashes alone are shuffled; those that repeat make a table of slots, whose size follows their number up to
    ``2**MAX_SLOTS`` bits and which every run is held against. A run in such a slot by chance is only looked at for nothing.
    """
    twice = written(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "twice")
    bits = min(MAX_SLOTS, max(16, int(16 * twice.count()).bit_length()))
    slot = F.shiftrightunsigned("h1", 64 - bits)
    words = twice.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    free(twice)
    shared = found.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("h1").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            real = (shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            yield batch.filter(pa.array(real))

    return found.mapInArrow(run, found.schema)


def later_spans(found: DataFrame) -> DataFrame:
    """The runs whose content stands at an earlier place too.

    First places are aggregated before the shuffle and written too: the join then has a plain
    exchange on either side, and a run that a third of all documents hold is split at run time.
    """
    place = F.struct("_k1", "_k2", "start")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    return found.join(written(first, "spans"), ["h1", "h2"]).where(place > F.col("first")).select("_k1", "_k2", "start", "stop")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 3, min_words: int = 25) -> DataFrame:
    """``df`` with the text that is left, ``n_sentences`` (before), ``n_removed`` and ``removed`` (structs ``start, stop`` of sentences)."""
    made = {"n_sentences": T.LongType(), "n_removed": T.LongType(), "removed": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))}
    found = written(spans(df, id_col, text_col, min_sentences, min_words), "runs")
    later = later_spans(possibly_repeated(found.where("h1 is not null").drop("sizes"))).distinct()
    marks = later.select("_k1", "_k2", F.struct("start", "stop").alias("s"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("sizes"))
    texts = found.where("h1 is null").select("_k1", "_k2", F.lit(None).cast(marks.schema["s"].dataType).alias("s"), F.col("stop").alias("n"), "sizes")
    per_doc = marks.unionByName(texts).groupBy("_k1", "_k2").agg(F.collect_list("s").alias("_spans"), F.max("n").cast("long").alias("_n"), F.first("sizes", ignorenulls=True).alias("_sizes"))
    per_doc = written(per_doc.withColumn("_sizes", F.when(F.size("_spans") > 0, F.col("_sizes"))), "later")
    free(found)
    kept = [c for c in df.columns if c not in made]
    out = row_key(df.select(kept), id_col, text_col).join(per_doc, ["_k1", "_k2"], "left").select(*kept, "_spans", "_n", "_sizes")
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, v) for k, v in made.items())])
    kinds = {"n_sentences": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, text_col):
            texts, n, sizes, spans = part.column(text_col).to_pylist(), part.column("_n"), part.column("_sizes"), part.column("_spans")
            gone, pieces, at = [0] * len(texts), [[] for _ in texts], spans.offsets.to_numpy()
            starts, stops = (x.to_numpy() for x in spans.values.flatten())
            for i in np.flatnonzero(np.diff(at)).tolist():
                size = n[i].as_py()
                mark = np.zeros(size + 1, np.int64)
                np.add.at(mark, starts[at[i] : at[i + 1]], 1)
                np.subtract.at(mark, stops[at[i] : at[i + 1]] + 1, 1)
                covered = np.cumsum(mark) > 0
                gone[i] = int(covered.sum())
                edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0)).reshape(-1, 2)
                place = unpacked(sizes[i].as_py(), size)[edges].ravel().tolist()
                texts[i] = "".join([texts[i][a:b] for a, b in zip([0, *place[1::2]], [*place[::2], None], strict=True)])
                pieces[i] = [{"start": a, "stop": b - 1} for a, b in edges.tolist()]
            cols = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, n, *(pa.array(v, kinds[k]) for k, v in (("n_removed", gone), ("removed", pieces)))], names=[*kept, *made])

    return out.mapInArrow(run, schema)
