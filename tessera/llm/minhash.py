"""MinHash near-duplicates: circulant signatures, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first deals a shingle's hash to one of ``2**BITS`` places, the
second, shifted circularly by k, is the k-th coordinate's order of places. Documents with equal sets are one
node from then on; nodes that share a band are candidates. Of the nodes of a bucket only a star is compared: all
against one leader. As long as a bucket's nodes are in several components after that, it is compared with another leader
and at last those outside its largest component are compared with all of it, in blocks of bounded size that give
nothing but links. Every link is confirmed on the full sets.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer words
than a shingle is one shingle as a whole; null ids are larger than any other as a component's name (a component of
null ids alone has a null name); rows with equal texts are one node, whether or not they repeat an id; an empty
table gives an empty table; columns added replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, free, mix64, row_key, utf8, written
from .components import connected

BITS = 18
BASE = 0x9E3779B97F4A7C15
LEADER_ROUNDS = 2
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
SPAN = 1 << 21
U = np.uint64


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse from 0 to ``SPAN``."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(SPAN, b, U)])) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _one_word(raw: np.ndarray) -> np.uint64:
    """The hash of one word of any length, a stretch at a time."""
    power, total, scale = _powers()[0], U(0), U(1)
    for at in range(0, len(raw), SPAN):
        part = raw[at : at + SPAN].astype(U) + U(1)
        total += (part * power[: len(part)]).sum(dtype=U) * scale
        scale *= power[SPAN]
    return total


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of other bytes than space and \\t to \\r; A-Z as a-z) and each text's first word's number.

    A word's hash is a polynomial in its bytes. Words are taken in stretches of ``SPAN`` bytes at most, so that memory is
    bounded by the text and not by a table of powers as long.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    raw = lower[raw]
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    if len(raw):
        firsts = offsets[:-1][np.diff(offsets) > 0]
        starts[firsts] = inside[1:-1][firsts]
        lasts = offsets[1:][np.diff(offsets) > 0] - 1
        ends[lasts] = inside[1:-1][lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers()
    out, k = np.zeros(len(s), U), 0
    with np.errstate(over="ignore"):
        while k < len(s):
            j = int(np.searchsorted(e, s[k] + SPAN, "right"))
            if j <= k:
                out[k], k = _one_word(raw[s[k] : e[k]]), k + 1
                continue
            lo = s[k]
            total = np.zeros(e[j - 1] - lo + 1, U)
            np.cumsum((raw[lo : e[j - 1]].astype(U) + U(1)) * power[: len(total) - 1], out=total[1:])
            out[k:j] = (total[e[k:j] - lo] - total[s[k:j] - lo]) * inverse[s[k:j] - lo]
            k = j
        return mix64(out + (e - s).astype(U)), np.searchsorted(s, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    h, at = word_hashes(raw, offsets)
    joined = np.zeros(max(0, len(h) - words + 1), U)
    for k in range(words):
        joined = mix64(joined * U(3) + h[k : k + len(joined)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(joined[a : b - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            one = np.array([b - a], U)
            for w in h[a:b]:
                one = mix64(one * U(5) + w)
            out.append(one)
        else:
            out.append(np.zeros(0, U))
    return out


@cache
def _shifted(coordinates: int) -> np.ndarray:
    """Row p: the second permutation's values at p, p + 1, ... (circularly): all coordinates of a shingle at place p."""
    order = np.random.default_rng(7).permutation(1 << BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The circulant MinHash signature of a set that isn't empty."""
    table, out = _shifted(coordinates), None
    places = (mix64(shingles ^ U(BASE)) >> U(64 - BITS)).astype(np.int64)
    for at in range(0, len(places), 4096):
        least = table[places[at : at + 4096]].min(axis=0)
        out = least if out is None else np.minimum(out, least)
    return out


def signatures(df: DataFrame, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """Adds ``n_shingles``, ``node`` (16 bytes that stand for the set; null for an empty one) and ``bands`` (their hashes)."""
    made = {"n_shingles": T.LongType(), "node": T.BinaryType(), "bands": T.ArrayType(T.LongType())}
    kept = [c for c in df.columns if c not in {*made, text_col}]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(k, v) for k, v in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix64(np.arange(1, rows + 1, dtype=U) * U(BASE)) | U(1)
        for part in batches_by_bytes(batches, text_col, 2 << 20):
            n, node, band = [], [], []
            for x in shingle_sets(*utf8(part.column(text_col)), words):
                n.append(len(x))
                if len(x):
                    node.append(mix64(x).sum(dtype=U).tobytes() + (np.bitwise_xor.reduce(mix64(x ^ U(BASE))) + U(len(x))).tobytes())
                    sig = signature(x, bands * rows).astype(U).reshape(bands, rows)
                    band.append(mix64((sig * weights).sum(axis=1, dtype=U) + np.arange(bands, dtype=U)).view(np.int64))
                else:
                    node.append(None)
                    band.append(None)
            cols = [pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, *made])

    return df.mapInArrow(run, schema)


def sets(df: DataFrame, text_col: str, words: int) -> DataFrame:
    """The text becomes ``shingles``: its set, as an array of 64-bit hashes."""
    kept = [c for c in df.columns if c not in {"shingles", text_col}]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_by_bytes(batches, text_col, 2 << 20):
            found = [x.view(np.int64) for x in shingle_sets(*utf8(part.column(text_col)), words)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.list_(pa.int64()))], names=[*kept, "shingles"])

    return df.mapInArrow(run, schema)


def _pairs(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _possible(n: Column, m: Column, percent: int) -> Column:
    """Whether the sets' sizes allow a similarity of ``percent``."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _star(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """``a, b``: each bucket's leader, another one each turn, with the members of other components than its own."""
    order = F.xxhash64("node", F.when(F.lit(turn) > 0, F.col("band")).otherwise(0), F.lit(turn))
    tops = members.groupBy("band", "h").agg(F.min(F.struct(order.alias("o"), "node", "n", "label")).alias("top")).select("band", "h", F.col("top.node").alias("lead"), F.col("top.n").alias("m"), F.col("top.label").alias("own"))
    met = members.join(written(tops, "leaders"), ["band", "h"]).where((F.col("label") != F.col("own")) & _possible(F.col("n"), F.col("m"), percent))
    return met.select(*_pairs("node", "lead")).distinct()


def linked_within(nodes: list[bytes], asked: np.ndarray, found: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of asked sets with all others, as edges to the first node that each is connected with."""
    size = np.array([len(x) for x in found], np.int64)
    _, element = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), size)
    times = np.bincount(element)
    element_of = np.cumsum(times > 1) - 1  # an element of one set alone adds to no intersection
    real = times[element] > 1
    element, owner = element_of[element[real]], owner[real]
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    q, r = np.flatnonzero(asked), np.flatnonzero(~asked)
    same = np.zeros((len(q), len(r)), np.float32)
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, 2048):
        lo, hi = np.searchsorted(element, [at, at + 2048])
        table = np.zeros((len(found), 2048), np.float32)
        table[owner[lo:hi], element[lo:hi] - at] = 1
        same += table[q] @ table[r].T
    same = same.astype(np.int64)  # counts are exact below 2**24 elements; what they are multiplied by isn't
    link = 100 * same >= percent * (size[q][:, None] + size[r][None, :] - same)
    first: dict[bytes, int] = {}
    name = np.array([first.setdefault(x, i) for i, x in enumerate(nodes)])
    label, far = np.arange(len(nodes)), len(nodes)
    while True:
        old = label.copy()
        if len(q) and len(r):
            np.minimum.at(label, name[q], np.where(link, label[name[r]][None, :], far).min(1))
            np.minimum.at(label, name[r], np.where(link, label[name[q]][:, None], far).min(0))
        if (old == label).all():
            break
    return [(nodes[label[i]], nodes[i]) for i in np.unique(name) if label[i] != i]


def _in_blocks(now: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links of the nodes that the leaders' rounds left apart from most of their bucket with all of it.

    Buckets with one leader are one group. In every group the nodes of other components than the largest are asked
    against all its nodes, in blocks of bounded size; only links leave a block.
    """
    order = F.xxhash64("node", F.lit(0), F.lit(0))
    tops = now.groupBy("band", "h").agg(F.min(F.struct(order.alias("o"), "node")).alias("top")).select("band", "h", F.col("top.node").alias("lead"))
    group = written(now.join(written(tops, "leaders"), ["band", "h"]).select("lead", "node", "n", "label").distinct(), "groups")
    parts = group.groupBy("lead", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    cut = lambda c, s: F.greatest(F.ceil(c / BLOCK_SETS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    most = parts.groupBy("lead").agg(F.max(F.struct("c", "label")).alias("main"), F.max_by("s", F.struct("c", "label")).alias("ms"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    most = written(most.where(F.col("c") > F.col("main.c")).select("lead", F.col("main.label").alias("main"), cut(F.col("c") - F.col("main.c"), F.col("s") - F.col("ms")).alias("nq"), cut(F.col("c"), F.col("s")).alias("nr")), "sizes")
    rows = group.join(most, "lead").join(own, "node").select("lead", "node", "label", "main", "nq", "nr", "shingles")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asked = rows.where("label <> main").select("lead", deal("nq").alias("qb"), upto("nr").alias("rb"), F.lit(True).alias("asked"), "node", "shingles")
    others = rows.select("lead", upto("nq").alias("qb"), deal("nr").alias("rb"), F.lit(False).alias("asked"), "node", "shingles")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        edges = linked_within([bytes(x) for x in part["node"]], part["asked"].to_numpy(bool), [np.asarray(x) for x in part["shingles"]], percent)
        return pd.DataFrame(edges, columns=["a", "b"])

    return asked.unionByName(others).groupBy("lead", "qb", "rb").applyInPandas(compare, "a binary, b binary")


def _linked(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda c: own.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    same = F.size(F.array_intersect("_a", "_b"))
    return both.where(100 * same >= percent * (F.size("_a") + F.size("_b") - same)).select("a", "b")


def node_components(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """``node, label`` of all nodes that are linked with another. ``members``: band, h, node, n; ``own``: node, shingles."""
    label = F.col("node").alias("label")
    now, labels, tested = members.select("*", label), None, None
    for turn in range(LEADER_ROUNDS + 1):
        if turn < LEADER_ROUNDS:
            pairs = _star(now, turn, percent)
            pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = written(_linked(pairs, own, percent), "links")
        else:
            links = written(_in_blocks(now, own, percent).distinct(), "links")
        if labels is None:
            labels = connected(links)
        elif not links.isEmpty():
            name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: B023, E731
            tops = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            merged = connected(tops).select(F.col("node").alias("label"), F.col("label").alias("top"))
            new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", label)
            labels = written(labels.unionByName(new).join(merged, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        free(links)
        if turn == LEADER_ROUNDS:
            return labels
        # A bucket of two is done; a larger one is not while its nodes are in several components.
        held = members.join(labels, "node", "left").select(*members.columns, F.coalesce("label", "node").alias("label"))
        split = held.groupBy("band", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("size > 2 and lo <> hi").select("band", "h")
        now = written(held.join(split, ["band", "h"], "left_semi"), "members")
        if now.isEmpty():
            return labels
    return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 25, rows: int = 5) -> DataFrame:
    """Each row's id, ``n_shingles``, ``component_id`` (smallest id it is linked with, directly or not) and ``kept``; and ``_k1``, ``_k2``.

    The bands' chance to miss a pair at the threshold itself is (1 - s**rows)**bands.
    """
    keyed = row_key(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_id", "_t")
    signed = written(signatures(keyed, "_t", words, bands, rows), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("key"), F.min("_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.select("node", F.col("key._k1").alias("_k1"), F.col("key._k2").alias("_k2"), "id", "n", "bands"), "nodes")
    single = nodes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    shared = single.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "h")
    members = written(single.join(written(shared, "shared"), ["band", "h"]), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("_k1", "_k2", "node")
    own = written(sets(keyed.join(wanted, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("node", "_t"), "_t", words), "sets")
    labels = node_components(members, own, percent)
    named = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = named.groupBy("label").agg(F.min("id").alias("component_id"))
    names = written(named.join(tops, "label").select("node", "component_id"), "components")
    free(nodes, members, own, labels)
    place = F.coalesce("node", F.encode(F.col("_k1").cast("string"), "utf-8"))  # nulls don't meet in one task
    out = signed.select(F.col("_id").alias(id_col), "n_shingles", "_k1", "_k2", place.alias("node")).join(names, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", id_col))
    return out.select(id_col, "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col(id_col)).alias("kept"), "_k1", "_k2")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one document of each component; rows that repeat the kept document's id and text stay with it."""
    kept = near_duplicates(df, id_col, text_col, **options).where("kept").select("_k1", "_k2")
    return row_key(df, id_col, text_col).join(written(kept, "kept"), ["_k1", "_k2"], "left_semi").select(*df.columns)
