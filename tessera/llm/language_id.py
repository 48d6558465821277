"""Language identification by Bayesian fusion of evidence.

The text's likelihood under each language is naive Bayes over hashed byte 4-grams (words are kept, all else is one
space); languages compete with an even background, so that a text of none is ``und``. The priors come from the
document's host: counts of what the texts alone say, by grouped aggregation, smoothed towards the address suffix's
counts and those towards all documents'. A language declared in markup is one more observation, right with a
reliability that is estimated from how often it agrees with the texts.

A document's own text is left out of the counts that make its prior, so that it isn't heard twice.

Defined cases: a null or empty text, or one without letters, has no likelihood: it is ``und`` and rejected; null hosts and
suffixes share one prior; a declared language that isn't known counts for nothing; repeated rows are judged alike (and
weigh by their number in the priors); without a labelled row every document is ``und``; every label that has a text is a
language; an empty table gives an empty table; columns added replace input columns of the same name. Texts and tags are
read whole. A language takes 1 MB of each worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, free, row_key, utf8, written

BITS = 18
EDGE = 31
BACKGROUND = "und"
#: One byte stands in four grams: the weight of a gram's log likelihood.
WEIGHT = 0.25


@dataclass
class Model:
    """``table``: the log likelihood of each gram under each language; the last column is the background's."""

    languages: list[str]
    table: np.ndarray


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed 4-grams of all texts, with an edge mark at both ends, and where each text's begin (n + 1 places)."""
    keep_table = np.full(256, 32, np.uint8)
    keep_table[97:123] = np.arange(97, 123)
    keep_table[65:91] = np.arange(97, 123)
    keep_table[128:] = np.arange(128, 256)
    n, edged = len(offsets) - 1, np.full(len(raw) + 2 * (len(offsets) - 1), EDGE, np.uint8)
    edged[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = keep_table[raw]
    raw, offsets = edged, offsets + 2 * np.arange(n + 1)
    blank = raw == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    text, at = raw[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    if len(text) < 4:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    capital = np.flatnonzero((text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3) & (text[1:] != 0x97)) + 1
    text[capital] += 32
    all_grams = np.ndarray((len(text) - 3,), "<u4", np.ascontiguousarray(text), 0, (1,))
    bucket = (all_grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    inside = np.ones(len(bucket), bool)
    for k in range(1, 4):  # grams that reach into the next text
        over = at[1:-1] - k
        inside[over[(over >= 0) & (over < len(inside))]] = False
    counts = np.concatenate([[0], np.cumsum(inside)])
    return bucket[inside].astype(np.int64), counts[np.minimum(at, len(inside))]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = 300, alpha: float = 0.02) -> Model:
    """Trains on a bounded sample: of each label the ``per_language`` different texts of smallest hash, whole texts."""
    rows = labelled.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(label_col).alias("y"), F.col(text_col).alias("t"))
    order, parts = F.xxhash64("t", F.lit("sample")), 1 << 30
    counts = [(r.y, r.n) for r in rows.groupBy("y").agg(F.approx_count_distinct(order, 0.02).alias("n")).collect()]
    # about twice as many as are taken come to the driver
    shares = F.create_map(*(F.lit(x) for y, n in counts for x in (y, int(min(1.0, 2 * per_language / max(1, n)) * parts) + 1)))
    taken: dict[str, list[tuple[int, str]]] = {}
    for r in rows.where(F.pmod(order, F.lit(parts)) < F.element_at(shares, F.col("y"))).select("y", "t", order.alias("o")).distinct().toLocalIterator() if counts else ():
        mine = taken.setdefault(r.y, [])
        mine.append((r.o, r.t))
        if len(mine) > 2 * per_language:
            mine.sort()
            del mine[per_language:]
    languages = sorted(taken)
    table = np.zeros((1 << BITS, len(languages) + 1), np.float32)
    for k, y in enumerate(languages):
        bucket, _ = grams(*utf8(pa.array([t for _, t in sorted(taken[y])[:per_language]], pa.string())))
        n = np.bincount(bucket, minlength=1 << BITS) + alpha
        table[:, k] = np.log(n / n.sum())
    table[:, -1] = -np.log(1 << BITS)
    return Model(languages, table)


def likelihoods(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The text becomes ``n_grams`` and ``likelihood`` (log, one for each language and the background's)."""
    kept = [c for c in df.columns if c not in (text_col, "n_grams", "likelihood")]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n_grams", T.LongType()), T.StructField("likelihood", T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast(model.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in batches_by_bytes(batches, text_col, 1 << 20):
            bucket, at = grams(*utf8(part.column(text_col)))
            n, sums = np.diff(at), np.zeros((part.num_rows, table.shape[1]))
            if full := np.flatnonzero(n).tolist():
                sums[full] = np.add.reduceat(table[bucket], at[:-1][full], axis=0, dtype=np.float64)
            cols = [pa.array(n, pa.int64()), pa.array(list(sums * WEIGHT), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *cols], names=[*kept, "n_grams", "likelihood"])

    return df.mapInArrow(run, schema)


def declared_in_markup(text: Column) -> Column:
    """The language that the first ``<html lang=...>`` of a text declares, without its region; else null."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    """What stands behind a host's last dot; null without one."""
    found = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([^.:]+)(?::\d+)?$", 1)
    return F.when(found != "", F.lower(found))


def _posterior(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def _sums(size: int) -> Column:
    return F.array(*(F.round(F.sum(F.element_at("post", k + 1)), 6) for k in range(size)))


def text_of_markup(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^<>]*>", " ")


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, declared: Column | None = None, host_weight: float = 20.0, suffix_weight: float = 100.0, sure: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, ``language``, ``confidence``, ``declared``, ``n_grams``, ``accepted``; and ``_k1``, ``_k2`` and the columns ``carry``.

    A document is accepted if a language, not the background, has a posterior of ``sure`` or more.
    """
    size = len(model.languages) + 1
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    said = declared if declared is not None else declared_in_markup(F.col(text_col))
    kept = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    base = row_key(df, id_col, text_col).select(F.col(id_col).alias("_id"), "_k1", "_k2", F.coalesce(host, F.lit("")).alias("host"), said.alias("declared"), *kept, F.col(text_col).alias("_t"))
    even = F.array(*[F.lit(0.0)] * (size - 1), F.lit(-2.0))
    seen = written(likelihoods(base, model, "_t").withColumn("post", _posterior(F.zip_with("likelihood", even, lambda a, b: a + b))), "likelihoods")
    real = seen.where("n_grams > 0")
    # counts of what the texts say: by host, by suffix, over all; each is smoothed towards the next
    hosts = written(real.groupBy("host").agg(F.count(F.lit(1)).alias("n"), _sums(size).alias("c")).withColumn("suffix", F.coalesce(suffix_of(F.col("host")), F.lit(""))), "hosts")
    unit = lambda: [F.sum(F.element_at("c", k + 1)) for k in range(size)]
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("sn"), F.array(*unit()).alias("sc"))
    everything = hosts.agg(F.sum("n").alias("n"), F.array(*unit()).alias("c")).first()
    zeros = F.array(*[F.lit(0.0)] * size)
    total, totals = F.lit(everything.n or 0), F.array(*map(F.lit, everything.c)) if everything.n else zeros
    both = written(hosts.join(suffixes, "suffix").select("host", "n", "c", "sn", "sc"), "counts")
    # how often a declared language agrees with the text
    codes = F.array(*map(F.lit, model.languages)) if model.languages else F.array().cast("array<string>")
    agree = real.where(F.array_contains(codes, F.col("declared"))).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.element_at("post", F.array_position(codes, F.col("declared")).cast("int"))), F.lit(0.0)).alias("s")).first()
    right = (agree.s + 4.0) / (agree.n + 5.0)
    told = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.when(~F.array_contains(codes, F.col("declared")) | F.col("declared").isNull(), 0.0).when(k == F.array_position(codes, F.col("declared")), F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log((1 - right) / max(1, size - 1))))))
    # a hot host is split at run time: its rows come from a written table by a plain exchange, its counts are one row
    joined = seen.join(both, "host", "left")
    counted = (F.col("n_grams") > 0).cast("int")
    own = F.when(F.col("n_grams") > 0, F.col("post")).otherwise(zeros)
    less = lambda c, n, p, w: F.zip_with(F.zip_with(c, own, lambda a, o: F.greatest(a - o, F.lit(0.0))), p, lambda a, b: (a + w * b) / (n - counted + w))
    overall = F.transform(F.zip_with(totals, own, lambda a, o: F.greatest(a - o, F.lit(0.0))), lambda a: (a + 1) / (total - counted + size))
    joined = joined.withColumn("_all", overall)
    joined = joined.withColumn("_all", F.when(F.col("sn").isNull(), F.col("_all")).otherwise(less("sc", F.col("sn"), "_all", suffix_weight)))
    joined = joined.withColumn("_prior", F.when(F.col("n").isNull(), F.col("_all")).otherwise(less("c", F.col("n"), "_all", host_weight)))
    scores = F.zip_with(F.zip_with("likelihood", "_prior", lambda a, p: a + F.log(F.greatest(p, F.lit(1e-9)))), told, lambda a, b: a + b)
    out = joined.withColumn("post", _posterior(scores))
    best = F.array_max("post")
    names = F.array(*map(F.lit, [*model.languages, BACKGROUND]))
    language = F.when((F.col("n_grams") > 0) & (best >= sure), F.element_at(names, F.array_position("post", best).cast("int"))).otherwise(BACKGROUND)
    out = out.select(F.col("_id").alias(id_col), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), language.alias("language"), F.when(F.col("n_grams") > 0, best).otherwise(0.0).alias("confidence"), "declared", "n_grams", (language != BACKGROUND).alias("accepted"), "_k1", "_k2")
    free(hosts)
    return out
