"""Approximate nearest neighbours by additive quantisation.

Residual codebooks over all dimensions are fitted on a bounded sample; a vector is encoded by beam search as one word of
each codebook, with the squared norms of the sum of its words and of itself. A query's inner products with all words
make its lookup table; codes are scored by table lookups and corrected by the stored norms (an inner product by what
the sum of the words is short of the vector). Only codes and norms meet the queries: rows stream past a block of queries, of
which each keeps the ``shortlist`` best. The best of all blocks are joined with the original vectors and scored in double
precision.

Equal vectors are one entry, as candidates with their smallest ids and as queries with all their rows, so that copies
neither use up the shortlist nor make one task long.

Defined cases: null, empty or zero vectors and those with null or non-finite components take no part, neither as queries nor as
candidates; a vector meets those of its own length; a row with a null id is a candidate, behind all others that tie, and never
a query; a query has all candidates if they are fewer than ``k``; ties go to the smaller id; rows that repeat an id are rows of
their own, as queries too (only a query's own row is left out); an empty table gives an empty table; columns of the
input other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, written


@dataclass
class Codebooks:
    words: np.ndarray
    """(codebooks, words, dimensions), float32."""


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, v, h1, h2, row``: the rows that take part, with two hashes of the vector and a number of the row's own."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(~bad & some)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))  # minus zero is zero
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"), F.monotonically_increasing_id().alias("row"))


def fit(vectors: DataFrame, codebooks: int = 24, words: int = 256, sample: int = 8192, rounds: int = 5, seed: int = 5) -> Codebooks:
    """Residual k-means on the ``sample`` vectors (column ``v``, all of one length) of smallest hash."""
    found = vectors.orderBy(F.xxhash64("v", F.lit("sample")), "v").limit(sample).select("v").toPandas()
    if found.empty:
        return Codebooks(np.zeros((0, 0, 0), np.float32))
    rest = np.array(found["v"].tolist(), np.float32)
    rng, out = np.random.default_rng(seed), []
    for _ in range(codebooks):
        centre = rest[rng.choice(len(rest), min(words, len(rest)), replace=False)].copy()
        for _ in range(rounds):
            near = ((centre * centre).sum(1)[None, :] - 2 * rest @ centre.T).argmin(1)
            total, n = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
            np.add.at(total, near, rest)
            centre[n > 0] = total[n > 0] / n[n > 0, None]
        near = ((centre * centre).sum(1)[None, :] - 2 * rest @ centre.T).argmin(1)
        rest = rest - centre[near]
        out.append(centre)
    return Codebooks(np.stack(out))


def encode(books: Codebooks, x: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one byte a codebook) and squared norms of the decoded vectors, by beam search over the codebooks."""
    m, w, d = books.words.shape
    codes = np.zeros((len(x), m), np.uint8)
    norms = np.zeros(len(x), np.float32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512].astype(np.float32)
        n = len(part)
        rest, cost, path = part[:, None, :], (part * part).sum(1)[:, None], np.zeros((n, 1, 0), np.uint8)
        for k in range(m):
            book = books.words[k]
            # the squared error once a word is taken off each of the beam's rests
            every = cost[:, :, None] + (book * book).sum(1)[None, None, :] - 2 * rest @ book.T
            flat = every.reshape(n, -1)
            b = min(beam, flat.shape[1])
            best = np.argpartition(flat, b - 1, axis=1)[:, :b] if b < flat.shape[1] else np.tile(np.arange(b), (n, 1))
            cost = np.take_along_axis(flat, best, 1)
            origin, word = best // w, best % w
            rest = np.take_along_axis(rest, origin[:, :, None], 1) - book[word]
            path = np.concatenate([np.take_along_axis(path, origin[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        top = cost.argmin(1)
        codes[at : at + n] = path[np.arange(n), top]
        decoded = part - rest[np.arange(n), top]
        norms[at : at + n] = (decoded * decoded).sum(1)
    return codes, norms


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def index(vectors: DataFrame, books: Codebooks, beam: int = 8) -> DataFrame:
    """``h1, h2, v, codes, norm, length`` of every vector: its words and the squared norms of their sum and of itself."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                codes, norms = encode(shared.value, x, beam)
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array((x * x).sum(1).astype(np.float32), pa.float32())]
                yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("v"), *made], names=["h1", "h2", "v", "codes", "norm", "length"])

    return vectors.select("h1", "h2", "v").mapInArrow(run, "h1 long, h2 long, v array<double>, codes binary, norm float, length float")


class Shortlists:
    """The best rows so far of a block of queries, by table lookups."""

    def __init__(self, books: Codebooks, queries: np.ndarray, keys: np.ndarray, size: int, measure: str):
        self.books, self.measure, self.size = books, measure, size
        self.queries, self.keys = queries.astype(np.float32), keys
        self.score = np.full((len(queries), size), -np.inf, np.float32)
        self.row = np.zeros((len(queries), size, 2), np.int64)

    def add(self, codes: np.ndarray, norm: np.ndarray, length: np.ndarray, keys: np.ndarray, step: int = 64) -> None:
        words = self.books.words
        for at in range(0, len(self.queries), step):
            tables = np.einsum("qd,mwd->mwq", self.queries[at : at + step], words)
            rough = np.zeros((len(codes), tables.shape[2]), np.float32)
            for m in range(len(words)):
                rough += tables[m][codes[:, m]]
            if self.measure == "l2":
                rough = 2 * rough - norm[:, None]
            else:
                rough *= np.sqrt(length / np.maximum(norm, 1e-30))[:, None]
            part = slice(at, at + step)
            every = np.concatenate([self.score[part], rough.T], axis=1)
            best = np.argpartition(-every, self.size - 1, axis=1)[:, : self.size]
            new = best - self.size
            held = np.take_along_axis(self.row[part], np.minimum(best, self.size - 1)[:, :, None], 1)
            self.row[part] = np.where((new >= 0)[:, :, None], keys[np.maximum(new, 0)], held)
            self.score[part] = np.take_along_axis(every, best, 1)

    def result(self) -> pa.RecordBatch:
        q, k = np.nonzero(self.score > -np.inf)
        columns = [self.keys[q, 0], self.keys[q, 1], self.row[q, k, 0], self.row[q, k, 1], self.score[q, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q1", "q2", "h1", "h2", "rough"])


def shortlists(indexed: DataFrame, queries: DataFrame, books: Codebooks, size: int, measure: str, query_block: int, row_block: int) -> DataFrame:
    """``q1, q2, h1, h2``: the ``size`` rows that look best to each query. Codes and norms alone are shuffled, once a block of queries."""
    p, q = max(1, -(-indexed.count() // row_block)), max(1, -(-queries.count() // query_block))
    deal = lambda n: F.pmod(F.xxhash64("h1", "h2"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    rows = indexed.select(every(q).alias("q"), deal(p).alias("p"), F.lit(True).alias("late"), "h1", "h2", none("array<double>").alias("v"), "codes", "norm", "length")
    asked = queries.select(deal(q).alias("q"), every(p).alias("p"), F.lit(False).alias("late"), "h1", "h2", "v", none("binary").alias("codes"), none("float").alias("norm"), none("float").alias("length"))
    both = asked.unionByName(rows).repartition(p * q, "q", "p").sortWithinPartitions("q", "p", "late")
    shared = indexed.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, vectors, keys, lists = None, [], [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("q", "p", "late")], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)] if len(place) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if block != (here := tuple(place[a, :2].tolist())):
                    if lists:
                        yield lists.result()
                    block, vectors, keys, lists = here, [], [], None
                part = batch.slice(a, b - a)
                own = np.stack([part.column(c).to_numpy() for c in ("h1", "h2")], 1)
                if not place[a, 2]:
                    vectors.append(_matrix(part.column("v")))
                    keys.append(own)
                    continue
                if lists is None and vectors:
                    lists = Shortlists(shared.value, np.concatenate(vectors), np.concatenate(keys), size, measure)
                for c in range(0, b - a, 4096) if lists else ():
                    few = part.slice(c, 4096)
                    codes = np.frombuffer(b"".join(few.column("codes").to_pylist()), np.uint8).reshape(few.num_rows, -1)
                    lists.add(codes, few.column("norm").to_numpy(), few.column("length").to_numpy(), own[c : c + 4096])
        if lists:
            yield lists.result()

    found = both.mapInArrow(run, "q1 long, q2 long, h1 long, h2 long, rough float")
    if p > 1:
        nth = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("rough"), "h1", "h2"))
        found = found.withColumn("nth", nth).where(F.col("nth") <= size)
    return found.select("q1", "q2", "h1", "h2")


def exact(pairs: DataFrame, vectors: DataFrame, measure: str) -> DataFrame:
    """``q1, q2, h1, h2, score`` of pairs by their original vectors, in double precision."""
    side = lambda a, b, v: vectors.select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("v").alias(v))
    both = pairs.join(side("h1", "h2", "x"), ["h1", "h2"]).join(side("q1", "q2", "y"), ["q1", "q2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("x")), _matrix(batch.column("y"))
                score = (x * y).sum(1) if measure == "ip" else -((x - y) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q1", "q2", "h1", "h2")), pa.array(score)], names=["q1", "q2", "h1", "h2", "score"])

    return both.select("q1", "q2", "h1", "h2", "x", "y").mapInArrow(run, "q1 long, q2 long, h1 long, h2 long, score double")


def search(rows: DataFrame, asked: DataFrame, k: int = 20, shortlist: int = 400, query_block: int = 1024, row_block: int = 1 << 16, measure: str = "ip", **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row of ``asked`` but itself. Both as ``usable`` gives them, of one length.

    ``measure``: ``ip`` (largest inner product) or ``l2`` (smallest distance; the score is its negative square).
    ``options`` are those of ``fit``.
    """
    key = ["h1", "h2"]
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_last("id"), "row")
    # of a vector that many rows repeat, the smallest ids alone: the limit works before the shuffle too
    first = written(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select(*key, "v", "id", "row", "nth"), "first")
    vectors = first.where("nth = 1").select(*key, "v")
    books = fit(vectors, **options)
    indexed = written(index(vectors, books), "codes")
    queries = written(asked.select(*key).distinct().join(indexed.select(*key, "v"), key), "queries")
    pairs = shortlists(indexed, queries, books, shortlist, measure, query_block, row_block)
    scored = exact(written(pairs, "pairs"), indexed, measure)
    ids = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "id", "row"))).alias("ids"))
    each = scored.join(ids, key).select("q1", "q2", "score", F.explode("ids").alias("x"))
    place = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.asc_nulls_last("x.id"), "x.row")
    near = each.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k + 1)
    near = near.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("nth", "x.id", "x.row", "score"))).alias("near"))
    near = written(near, "near")
    out = asked.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("id").alias("query_id"), F.col("row").alias("own")).join(near, ["q1", "q2"])
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("own")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "x"))
    free(queries)
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, **options) -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``, by largest inner product. Each length of vectors is a search of its own."""
    rows = written(usable(df, id_col, vector_col), "vectors")
    out = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    for (length,) in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        same = rows.where(F.size("v") == length)
        out = out.unionByName(search(same, same.where(F.pmod("id", F.lit(every)) == 0), k, **options))
    return out
