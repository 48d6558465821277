"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are lower-cased, runs of other characters than letters and digits become one space. A benchmark item is cut
into overlapping segments of ``segment`` bytes, one every ``STRIDE`` bytes (the last one ends with the item; a shorter item
is one segment), so that a verbatim part of ``segment + STRIDE - 1`` bytes (55 as set) is found at any offset. A segment that
aligns to a text with ``e`` edits at most shares ``length - q + 1 - q * e`` q-grams with it at least, all on diagonals
that are within ``e`` of each other. So the q-grams that a text shares with a segment are counted in bands of diagonals
that overlap by ``e``; only bands with that many are aligned, by dynamic programming within the band.

Defined cases: a null or empty text, or one shorter than every segment, holds nothing; null or empty items are not looked for;
items of fewer than ``MIN_BYTES`` bytes are found as whole items between word edges and without edits, those of fewer than
``Q`` bytes only as the whole of a text; repeated items are found each under its id; repeated rows are judged alike; an empty
table gives an empty table; columns added replace input columns of the same name. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, free, utf8, written

Q = 8
SEGMENT, STRIDE, RATE, MIN_BYTES = 48, 8, 0.07, 40
BLOCK_BYTES = 1 << 20
SLOTS = 22
#: Pairs of a text's and a segment's q-grams that are looked at together, and the bytes a segment with its edits and band can reach over.
MAX_PAIRS, REACH = 4_000_000, 256
ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces for all that isn't a letter, a digit or part of a non-ASCII character."""
    table = np.full(256, 32, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        table[a:b] = np.arange(a, b)
    table[65:91] = np.arange(97, 123)
    raw = table[raw]
    # accented capitals of Latin-1 (C3 80 to C3 9E, but for the multiplication sign)
    capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3) & (raw[1:] != 0x97)) + 1
    raw[capital] += 32
    blank = raw == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    keep[firsts] = ~blank[firsts]
    return raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


@dataclass
class Index:
    """The q-grams of all segments of a block of items."""

    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    edits: np.ndarray
    items: np.ndarray
    item_bytes: np.ndarray
    slots: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    owners: np.ndarray
    places: np.ndarray

    @property
    def needed(self) -> np.ndarray:
        return np.maximum(1, self.lengths - Q + 1 - Q * self.edits)


def grams_of(text: np.ndarray) -> np.ndarray:
    """The q-gram (8 bytes as one number) at every place."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", np.ascontiguousarray(text), 0, (1,)).astype(np.uint64)


def build_index(ids: list[int], texts: list[str], segment: int = SEGMENT, rate: float = RATE) -> Index:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    text, offsets = normalise(raw, offsets)
    starts, lengths, owner = [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b > a and text[b - 1] == 32:
            b -= 1
        if b > a:
            n = min(segment, b - a)
            for s in sorted({*range(a, b - n + 1, STRIDE), b - n}):
                starts.append(s), lengths.append(n), owner.append(i)
    starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
    size = np.diff(offsets)
    # an edit budget that leaves the lemma a count above 1
    edits = np.minimum((lengths * rate).astype(np.int64), np.maximum(0, (lengths - Q) // Q - 1))
    edits[lengths < MIN_BYTES] = 0
    rows = [(grams_of(text[s : s + n]), k) for k, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True))]
    flat = np.concatenate([g for g, _ in rows]) if rows else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows]) if rows else np.zeros(0, np.int64)
    places = np.concatenate([np.arange(len(g)) for g, _ in rows]) if rows else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    slots = np.zeros(1 << SLOTS, bool)
    slots[(grams * ODD) >> np.uint64(64 - SLOTS)] = True
    return Index(text, starts, lengths, edits, np.array(ids, np.int64)[owner] if owner else np.zeros(0, np.int64), size[owner] if owner else np.zeros(0, np.int64), slots, grams, np.append(first, len(flat)), owners[order], places[order])


def aligned(index: Index, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, segments: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The fewest edits between each segment and a stretch of text[lo:hi] that starts within ``width`` places from ``low``; where it ends.

    A cell is a diagonal; all candidates take a step along their segments together.
    """
    top, far = int(index.lengths[segments].max(initial=0)), 1 << 20
    diagonal = low[:, None] + np.arange(width)[None, :]
    cost = np.zeros((len(segments), width), np.int32)
    best, end = np.full(len(segments), far), np.zeros(len(segments), np.int64)
    ramp = np.arange(width, dtype=np.int32)[None, :]
    for i in range(top):
        ends = index.lengths[segments] == i
        if ends.any():
            best[ends], end[ends] = cost[ends].min(axis=1), (diagonal[ends] + i)[np.arange(ends.sum()), cost[ends].argmin(axis=1)]
        place = diagonal + i
        inside = (place >= lo[:, None]) & (place < hi[:, None])
        want = index.text[np.minimum(index.starts[segments] + i, len(index.text) - 1)]
        step = cost + np.where(inside & (text[np.clip(place, 0, len(text) - 1)] == want[:, None]), 0, 1)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
    ends = index.lengths[segments] == top
    if ends.any():
        best[ends], end[ends] = cost[ends].min(axis=1), (diagonal[ends] + top)[np.arange(ends.sum()), cost[ends].argmin(axis=1)]
    return best, end


def as_rows(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    return [(d, s, e) for (d, s), e in sorted(found.items())]


def tiny(index: Index, text: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], int]:
    """The items too short for a q-gram that are the whole of a text."""
    items: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(index.lengths < Q).tolist():
        items.setdefault(index.text[index.starts[k] : index.starts[k] + index.lengths[k]].tobytes(), []).append(k)
    rows = np.flatnonzero(np.diff(at) <= Q).tolist() if items else ()
    return {(d, k): 0 for d in rows for k in items.get(text[at[d] : at[d + 1]].tobytes().strip(b" "), ())}


def whole(index: Index, text: np.ndarray, at: np.ndarray, doc: np.ndarray, segment: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """The texts and short items that have all q-grams of the item on one diagonal, between word edges."""
    if not len(doc):
        return []
    order = np.lexsort((start, segment, doc))
    doc, segment, start = doc[order], segment[order], start[order]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 0) | (np.diff(segment) != 0) | (np.diff(doc) != 0)]))
    size = np.diff(np.append(edge, len(doc)))
    edge = edge[size == index.lengths[segment[edge]] - Q + 1]
    doc, segment, start = doc[edge], segment[edge], start[edge]
    end = start + index.lengths[segment]
    free = (start == at[doc]) | (text[start - 1] == 32)
    free &= (end == at[doc + 1]) | (text[np.minimum(end, len(text) - 1)] == 32)
    return list(zip(doc[free].tolist(), segment[free].tolist(), strict=True))


def hits(grams: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """Which q-grams' slots are taken."""
    return slots[(grams * ODD) >> np.uint64(64 - bits)]


def search(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Text number, segment and edits of every segment that aligns to a text within its budget.

    Places that share q-grams are taken in ranges of a bounded number of pairs; ranges overlap by more than a segment's reach.
    """
    text, at = normalise(raw, offsets)
    out = tiny(index, text, at)
    if not len(index.starts) or len(text) < Q:
        return as_rows(out)
    grams = grams_of(text)
    spot = np.flatnonzero(hits(grams, index.slots, SLOTS))
    found = np.searchsorted(index.grams, grams[spot])
    found[found == len(index.grams)] = 0
    real = index.grams[found] == grams[spot]
    spot, found = spot[real], found[real]
    doc = np.searchsorted(at, spot, "right") - 1
    real = spot + Q <= at[doc + 1]
    spot, found, doc = spot[real], found[real], doc[real]
    upto = np.cumsum(index.at[found + 1] - index.at[found])
    start = 0
    while start < len(spot):
        base = upto[start - 1] if start else 0
        end = max(np.searchsorted(upto, base + MAX_PAIRS, "right"), np.searchsorted(spot, spot[start] + 2 * REACH), start + 1)
        part = slice(start, end)
        _search_range(index, text, at, spot[part], found[part], doc[part], out)
        if end >= len(spot):
            break
        start = max(start + 1, int(np.searchsorted(spot, spot[end] - REACH)))
    return as_rows(out)


def _search_range(index: Index, text: np.ndarray, at: np.ndarray, spot: np.ndarray, found: np.ndarray, doc: np.ndarray, out: dict[tuple[int, int], int]) -> None:
    count = index.at[found + 1] - index.at[found]
    total = int(count.sum())
    posting = np.repeat(index.at[found] - (np.cumsum(count) - count), count) + np.arange(total)
    segment = index.owners[posting]
    diagonal = np.repeat(spot, count) - index.places[posting]
    doc = np.repeat(doc, count)
    short = index.lengths[segment] < MIN_BYTES
    for d, k in whole(index, text, at, doc[short], segment[short], diagonal[short]):
        out[d, k] = 0
    diagonal, segment, doc = diagonal[~short], segment[~short], doc[~short]
    slack = int(index.edits.max())
    step = max(16, 1 << slack.bit_length())
    band = diagonal // step
    twice = diagonal - band * step < slack
    band, segment, doc = (np.concatenate([x, y[twice]]) for x, y in ((band, band - 1), (segment, segment), (doc, doc)))
    needed = index.needed
    # counts by a hash of segment and band drop most places before those that are left are counted exactly
    bucket = ((band * 1_000_003 + segment * 7_919) & ((1 << 20) - 1)).astype(np.int64)
    real = np.bincount(bucket, minlength=1 << 20)[bucket] >= needed[segment]
    band, segment, doc = band[real], segment[real], doc[real]
    order = np.lexsort((band, segment, doc))
    band, segment, doc = band[order], segment[order], doc[order]
    if not len(band):
        return
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(band) != 0) | (np.diff(segment) != 0) | (np.diff(doc) != 0)]))
    size = np.diff(np.append(edge, len(band)))
    edge = edge[size >= needed[segment[edge]]]
    for part in np.array_split(edge, max(1, len(edge) // 4096)):
        if not len(part):
            continue
        b, s, d = band[part], segment[part], doc[part]
        best, _ = aligned(index, text, at[d], at[d + 1], b * step - slack, s, step + 3 * slack + 1)
        for k in np.flatnonzero(best <= index.edits[s]).tolist():
            key = (int(d[k]), int(s[k]))
            out[key] = min(out.get(key, 1 << 20), int(best[k]))


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("segments", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("edits", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("segments", pa.int32()), ("share", pa.float64()), ("edits", pa.int32())]))


def _found(index: Index, raw: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    """Of each text, the items found."""
    found, last = [[] for _ in offsets[1:]], {}
    for d, s, e in search(index, raw, offsets):
        item, size = int(index.items[s]), int(index.lengths[s])
        mine = next((x for x in found[d] if x["item_id"] == item), None)
        if mine is None:
            found[d].append(mine := {"item_id": item, "segments": 0, "share": 0.0, "edits": 0})
        mine["segments"] += 1
        # segments overlap and come in order: what the ones before cover counts once
        start = int(index.starts[s])
        covered, counted = last.get((d, item), (start, start))
        mine["share"] = min(1.0, mine["share"] + (start + size - max(start, covered)) / max(1, int(index.item_bytes[s])))
        if start >= counted:
            mine["edits"] += e
            counted = start + size
        last[d, item] = start + size, counted
    return found


def _with_found(df: DataFrame, text_col: str, index: Index, into: str = "found") -> DataFrame:
    shared, kept = df.sparkSession.sparkContext.broadcast(index), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, text_col, 2 << 20):
            found = pa.array(_found(shared.value, *utf8(part.column(text_col))), _ARROW)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], names=[*kept, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, FOUND)]))


def taken_slots(items: DataFrame, bits: int, segment: int, rate: float) -> np.ndarray:
    """A table of ``2**bits`` slots, true where an item's q-gram falls. At most ``2**bits / 64`` numbers come to the driver, whatever the number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, "t", 1 << 20):
            slot = np.unique((build_index([0] * part.num_rows, part.column("t").to_pylist(), segment, rate).grams * ODD) >> np.uint64(64 - bits))
            word, first = np.unique(slot >> np.uint64(6), return_index=True)
            made = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first) if len(slot) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(made.view(np.int64))], names=["word", "bits"])

    words = items.select("t").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for r in words.toLocalIterator():
        table[r.word] = np.int64(r.bits).view(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def least_needed(items: DataFrame, segment: int, rate: float) -> int:
    """The fewest q-grams that any segment must share with a text that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, "t", 1 << 20):
            index = build_index([0] * part.num_rows, part.column("t").to_pylist(), segment, rate)
            if len(found := index.needed[index.lengths >= Q]):
                yield pa.RecordBatch.from_arrays([pa.array([int(found.min())], pa.int64())], names=["n"])

    return items.select("t").mapInArrow(run, "n long").agg(F.min("n")).first()[0] or 1


def possible(df: DataFrame, slots: np.ndarray, bits: int, needed: int, reach: int) -> DataFrame:
    """The rows (column ``t``) whose texts have ``needed`` q-grams with taken slots within ``reach`` bytes, and those too short to have one."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).view(bool)
        for part in batches_by_bytes(batches, "t", 2 << 20):
            text, at = normalise(*utf8(part.column("t")))
            keep = np.diff(at) <= Q
            if len(text) >= Q:
                upto = np.concatenate([[0], np.cumsum(hits(grams_of(text), own, bits))])
                ends = np.minimum(np.arange(len(upto)) + reach, len(upto) - 1)
                full = np.flatnonzero(upto[ends] - upto >= needed)
                keep[np.searchsorted(at, full[full < len(text)], "right") - 1] = True
            yield part.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def annotate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", segment: int = SEGMENT, rate: float = RATE, block_bytes: int = BLOCK_BYTES, into: str = "found") -> DataFrame:
    """Adds ``found`` (or ``into``): for each benchmark item that a text holds, the segments found, the share of the item's bytes they cover and the edits (of those that don't overlap).

    A benchmark of ``block_bytes`` bytes at most is one index that goes to every task, and nothing is shuffled. A larger one first
    makes a table of bounded size of its q-grams' slots, which lets the few texts that can hold an item through in one pass; these
    are written, searched for one block of items after the other, and what is found is joined to the rows by the text's hash.
    """
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    df = df.drop(into)
    index_of = lambda rows: build_index([r.i for r in rows], [r.t for r in rows], segment, rate)
    if blocks == 1:
        return _with_found(df, text_col, index_of(items.distinct().collect()), into)
    items = written(items.distinct().withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition("b"), "items")
    bits = min(30, max(SLOTS, int(16 * total).bit_length()))
    key = {"_h1": F.xxhash64(F.col(text_col)), "_h2": F.xxhash64(F.lit("text"), F.col(text_col))}
    texts = df.select(*(v.alias(k) for k, v in key.items()), F.col(text_col).alias("t"))
    needed = least_needed(items, segment, rate)
    few = possible(texts, taken_slots(items, bits, segment, rate), bits, needed, REACH)
    few = written(few.dropDuplicates(["_h1", "_h2"]), "possible")
    parts = []
    for b in range(blocks):
        rows = items.where(F.col("b") == b).collect()
        parts.append(written(_with_found(few, "t", index_of(rows)).where(F.size("found") > 0).select("_h1", "_h2", "found"), "found"))
    every = reduce(DataFrame.unionByName, parts).groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("found")).alias("_new"))
    free(items, few)
    joined = df.withColumns(key).join(written(every, "found"), ["_h1", "_h2"], "left")
    free(*parts)
    return joined.select(*df.columns, F.coalesce("_new", F.array().cast(FOUND)).alias(into))


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows whose texts hold no part of a benchmark item, with all their columns."""
    return annotate(df, benchmark, text_col, into="_parts", **options).where(F.size("_parts") == 0).select(df.columns)
