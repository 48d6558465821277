"""URL filter: allow and block rules, then a logistic regression on hashed character n-grams of host and path.

Pages are judged by DataFrame expressions alone: nothing is shuffled. The model is fitted by Spark's own DataFrame-based
logistic regression over a small hand-labelled table (``max_rows`` at most), within the JVM. A URL is blocked from a
probability of one half on.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the
method (no n-grams: the bias alone); any row is judged by itself, so repeated rows are judged alike; an empty
table gives an empty table; columns that are added replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_labels
from .common import LOWER, UPPER, free, written

BUCKETS = 1 << 14
SIZES = (3, 4)
def labelled(spark: SparkSession) -> DataFrame:
    """The hand-labelled table ``url, label`` (1: block)."""
    return spark.createDataFrame(url_labels.rows(), "url string, label int")


def host(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(part: Column, name: str, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Column:
    """Hashed character n-grams of ``^part$``, apart for each ``name``: an array of bucket numbers from 1."""
    edged = F.concat(F.lit("^"), part, F.lit("$"))
    cut = [F.regexp_extract_all(edged, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
    return F.transform(F.concat(*cut), lambda g: (F.pmod(F.xxhash64(F.lit(name), g), F.lit(buckets)) + 1).cast("int"))


def features(url: Column, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Column:
    return F.when(F.coalesce(url, F.lit("")).contains("://"), F.concat(grams(host(url), "host", sizes, buckets), grams(path(url), "path", sizes, buckets))).otherwise(F.array().cast("array<int>"))


def fit(rows: DataFrame, url_col: str = "url", label_col: str = "label", decay: float = 1e-4, iterations: int = 40, max_rows: int = 1024, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> list[float]:
    """The ``buckets`` weights, the bias last, fitted on the ``max_rows`` labelled rows of smallest hash; feature vectors have length 1.

    Labels all of one kind, or none at all, give the bias alone.
    """
    kept = rows.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(url_col).alias("u"), F.col(label_col).cast("double").alias("label"))
    kept = kept.distinct().orderBy(F.xxhash64("u", "label"), "u", "label").limit(max_rows).coalesce(1)
    held = written(kept.select("label", F.transform(features(F.col("u"), sizes, buckets), lambda b: b.cast("string")).alias("terms")), "labelled")
    out, seen = [0.0] * (buckets + 1), {r.label: r.n for r in held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        out[-1] = math.log((seen.get(1.0, 0) + 1) / (seen.get(0.0, 0) + 1))
    else:
        terms = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=buckets).fit(held)
        unit = Normalizer(inputCol="counts", outputCol="features").transform(terms.transform(held))
        model = LogisticRegression(regParam=decay, standardization=False, maxIter=iterations).fit(unit)
        for term, w in zip(terms.vocabulary, model.coefficients.toArray().tolist(), strict=True):
            out[int(term) - 1] = w
        out[-1] = model.intercept
    free(held)
    return out


def score(url: Column, weights: list[float], sizes: tuple[int, ...] = SIZES) -> Column:
    """The probability that a URL is to be blocked."""
    buckets = len(weights) - 1
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folds to one literal
    # repeated n-grams weigh by their count; the vector's length is 1
    counts = features(url, sizes, buckets)
    total = F.aggregate(counts, F.lit(0.0), lambda s, b: s + F.element_at(table, b))
    ordered = F.array_sort(counts)
    square = F.aggregate(
        ordered, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, b: F.struct(b.alias("last"), F.when(b == s["last"], s["run"] + 1).otherwise(1.0).alias("run"), (s["sum"] + F.when(b == s["last"], 2 * s["run"] + 1).otherwise(1.0)).alias("sum")),
        lambda s: s["sum"],
    )
    return 1 / (1 + F.exp(-(total / F.greatest(F.sqrt(square), F.lit(1.0)) + F.lit(weights[-1]))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], url_col: str = "url", threshold: float = 0.5, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Adds ``host, path, rule, score, verdict``.

    A rule is (verdict, host, path): it fits its host and all subdomains if the path starts with the rule's;
    of those that fit, the longest (host and path together, then host, then by name) wins. Where none fits, the
    method judges. The rules are written out in the plan: a list of some thousands at most.
    """
    out = pages.withColumns({"host": host(F.col(url_col)), "path": path(F.col(url_col))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    out = out.withColumns({"rule": rule, "score": score(F.col(url_col), weights, sizes), "_said": verdict})
    return out.withColumn("verdict", F.coalesce("_said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop("_said")
