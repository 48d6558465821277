"""The registered queries of the training-data operators, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, byte_bpe, decontaminate, language_id, license_scan, line_dedup, minhash, span_dedup, url_filter, warc
from .common import scratch_path

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: The URL rules (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = TOKENIZER) -> tuple[dict[bytes, int], str]:
    """The ranks and the pre-token pattern of an installed public tokenizer."""
    import public_tokenizers

    return byte_bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in one table: hosts, suffixes and declarations come from the pages, sources count as hosts. Ids are whole numbers throughout: a page's ``doc_id`` is -1 - its id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), "text", F.col("source").alias("host"), language_id.declared_in_markup(F.col("text")).alias("said"))
    web = pages.select((-1 - F.col("page_id").cast("long")).alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), language_id.text_of_markup(F.col("html")).alias("text"), url_filter.host(F.col("url")).alias("host"), language_id.declared_in_markup(F.col("html")).alias("said"))
    found = language_id.identify(text.unionByName(web), language_id.fit(docs), host_col="host", declared=F.col("said"), carry=("page_id",))
    return found.select("doc_id", "page_id", "language", "confidence", "declared", "n_grams", "accepted")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", F.explode("found").alias("f"))
    return rows.select("doc_id", "f.item_id", "f.segments", "f.share", "f.edits")


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = span_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(url_filter.labelled(spark))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, weights).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8, "op9_line_dedup": OP9, "op10_minhash": OP10}


OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT h, max(page_id) AS top FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.h)) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""

OP9 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
     w AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS pos FROM d),
     x AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS win,
                  trim(l[pos + 1] || l[pos + 2] || l[pos + 3], ' ') <> '' AS real FROM w),
     r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM x WHERE real),
     c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE nth > 1),
     k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(d.l) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN k.gone IS NULL THEN d.text ELSE
         coalesce(array_to_string([d.l[i + 1] FOR i IN range(0, len(d.l)) IF NOT list_contains(k.gone, i)], chr(10)), '') END AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP10 = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
     u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
     r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
     m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id, m.component_id = s.doc_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""
