"""WARC archives: revisit resolution and writing with fresh headers.

Headers alone are shuffled by payload digest to find the records that repeat a payload; each becomes a
``revisit`` of the one ``response`` that is kept. Archives are written by Spark's text sink, whose line
separator is the blank lines that end a record, and read by ``Content-Length``.

Defined cases: a null payload is empty; a null key is the smallest and refers to nothing when it alone is left;
rows that tie on the largest key of equal payloads are all responses, each with its own URL; null URLs leave the URI header out;
CR and LF in a URL become spaces; payloads shorter than ``least`` are all responses; an empty table gives
archives without records; payloads are compared by SHA-1, xxHash and length together. Each archive file is
one gzip stream of whole records.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, written

END = "\r\n\r\n"
FILE_BYTES = 24 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """What a record's header says of each payload: ``key, url, payload_bytes, payload_digest`` and a second hash ``check``."""
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(key_col).cast("long").alias("key"), F.col(url_col).alias("url"),
        F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"), F.xxhash64(raw).alias("check"),
    )


def originals(found: DataFrame, least: int) -> DataFrame:
    """For each payload of ``least`` bytes at least that several records share, the largest key and its URL.

    Aggregated before the shuffle: a payload that a third of all records share is one row a task.
    """
    top = F.max(F.struct(F.coalesce("key", F.lit(NULL_ID)).alias("k"), F.col("key"), F.col("url")))
    return (
        found.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes", "check")
        .agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
        .where("n > 1")
        .select("payload_digest", "payload_bytes", "check", F.col("top.key").alias("original"), F.col("top.url").alias("original_url"))
    )


def resolve(found: DataFrame, least: int = 1000) -> DataFrame:
    """Every header with ``record_type`` and, for a revisit, ``refers_to`` and the original's URL.

    Originals are written first: the join has a plain exchange on either side, so a payload that a third of all records
    repeat is split at run time, into as many parts as it needs.
    """
    joined = found.join(written(originals(found, least), "originals"), ["payload_digest", "payload_bytes", "check"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    return joined.select(
        "key", "url", "payload_bytes", "payload_digest", "check",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("original_url"),
    )


def _record_id(key) -> "F.Column":
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def records(pages: DataFrame, resolved: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2025-01-01T00:00:00Z") -> DataFrame:
    """One string ``value`` a record: fresh headers and the block, without the blank lines that end it.

    ``resolved`` has few bytes a row; payloads move once, by key, and only to meet their decision.
    """
    wide = pages.select(F.coalesce(F.col(key_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    wide = wide.withColumn("check", F.xxhash64(F.col("payload").cast("binary")))
    # several rows may repeat key and payload: they count as one decision, and each keeps its own URL
    said = resolved.drop("url").withColumn("k", F.coalesce("key", F.lit(NULL_ID))).dropDuplicates(["k", "check"])
    both = wide.join(said, ["k", "check"])
    url = lambda c: F.regexp_replace(c, "[\r\n]+", " ")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("key"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.coalesce(line("X-Record-Key", F.col("key").cast("string")), F.lit("")),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"))),
            F.coalesce(line("WARC-Refers-To-Target-URI", url(F.col("original_url"))), F.lit("")), line("X-Refers-To-Key", F.col("refers_to").cast("string")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return both.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Deduplicated archives of ``pages`` under ``path``, in files of about ``file_bytes`` bytes before compression."""
    found = headers(pages, key_col, url_col, payload_col)
    mean = found.agg(F.avg(F.col("payload_bytes") + 600)).first()[0] or 600
    made = records(pages, resolve(found, least), key_col, url_col, payload_col)
    made.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


def _parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record; one record at a time is in memory."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a WARC record ends within its header")
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != END.encode():
            raise ValueError("a WARC record doesn't end where its length says")
        yield head, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives: ``record_id, record_type, key, url, payload_digest, payload_bytes, refers_to_id, refers_to_key, payload``.

    A response's digest and length are taken anew from its payload; a revisit's from its header.
    """
    schema = "record_id string, record_type string, key long, url string, payload_digest string, payload_bytes long, refers_to_id string, refers_to_key long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import hashlib
        import io

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for value in batch.column("content"):
                rows, size = [], 0
                for h, block in _parse(gzip.open(io.BytesIO(value.as_py()))):
                    http, _, payload = block.partition(END.encode())
                    if h["warc-type"] == "response":
                        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    else:
                        digest, payload = h["warc-payload-digest"].removeprefix("sha1:"), None
                        n = int(http.decode().lower().rpartition("content-length: ")[2])
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((h["warc-record-id"], h["warc-type"], number("x-record-key"), h.get("warc-target-uri"), digest, n, h.get("warc-refers-to"), number("x-refers-to-key"), payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(run, schema)
