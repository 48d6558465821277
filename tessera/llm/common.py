"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a folder of its own; a cluster raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder, grouped by application; what is still there goes when the application ends."""
    own = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    at, fs = _file_system(spark, own)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut from its lineage: written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Removes tables that ``written`` made, once nothing reads them any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_scratch", None)):
            at, fs = _file_system(t.sparkSession, path)
            fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """All tables written inside go when the block ends: for a stage whose result has been written elsewhere by then."""
    at, fs = _file_system(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")
    names = lambda: {s.getPath().toString() for s in fs.listStatus(at)} if fs.exists(at) else set()
    before, kept = names(), []
    try:
        yield kept.append
    finally:
        keep = {t._scratch.rpartition("/")[2] for t in kept}
        for path in names() - before:
            if path.rpartition("/")[2] not in keep:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.

    ``lower`` is the fast path; the two characters whose lower case holds an ASCII letter
    (the Kelvin sign, the dotted capital I) send a text to ``translate`` instead. Other
    non-ASCII letters may come back in lower case: use it where only ASCII matters.
    """
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``_k1`` (the id; nulls are the smallest) and ``_k2`` (the text's hash).

    Rows that repeat both id and text have one key and get one decision.
    """
    return df.withColumns({"_k1": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_k2": F.xxhash64(F.col(text_col))})


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of an Arrow string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def batches_by_bytes(batches, text: str, limit: int = 8 << 20):
    """Slices of Arrow batches holding about ``limit`` bytes of the column ``text`` at most (one row at least)."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.cumsum(np.diff(utf8(batch.column(text))[1]) + 64)
            start = 0
            while start < batch.num_rows:
                base = size[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
                yield batch.slice(start, end - start)
                start = end
            pa.default_memory_pool().release_unused()
    finally:
        release_memory()


def release_memory() -> None:
    """Gives freed memory back to the system: an idle Python worker keeps none that others on its executor need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
