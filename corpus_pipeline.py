"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and columns of any further names,
which it hands on as they are (the last stage gives its own columns alone). What a stage writes on its way is removed
once its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, language_id, line_dedup, minhash
from tessera.llm.common import free, row_key, scratch, written
from tessera.llm.queries import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null and empty texts and those without letters among them.

    Rows that repeat id and text stay or go together; without any label (``lang``) no language is known and all go.
    """
    found = language_id.identify(docs, language_id.fit(docs), host_col="source").where("accepted").select("_k1", "_k2")
    keyed = row_key(docs, "doc_id", "text")
    return keyed.join(written(found, "accepted"), ["_k1", "_k2"], "left_semi").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of three lines that stand at an earlier place too are taken out of the texts; all rows stay.

    Places are ordered by id (null first), then text; a null text stays null, a text all of whose lines go is empty. ``n_chars``
    is counted anew where there is such a column.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    left = line_dedup.dedup(docs.withColumnsRenamed(own)).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id (five-word shingles, similarity of 0.8 or more).

    Documents without words are like none and stay; of equal texts with null ids alone all stay; rows that repeat the kept
    document's id and text stay with it.
    """
    return minhash.dedup(docs, words=5, percent=80).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a part of a benchmark item go; null and empty texts hold none. An empty benchmark lets all stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text becomes ids, which are decoded again; null and empty texts have none. Gives a row a document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    done = byte_bpe.round_trip(docs.select("doc_id", "text"), *vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("minhash", near_stage), ("decontaminate", benchmark_stage), ("byte_bpe", token_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), STAGES[-1][1]
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            kept = written(stage(spark, docs, sf_dir), name)
            keep(kept)
        free(docs)
        docs = kept
    return last(spark, docs, sf_dir)
