"""Line dedup by overlapping windows of consecutive lines.

Every run of ``window`` lines is hashed to 128 bits; a window that stands at several places anywhere stays at the
first (by document id, then text hash, then line) and the lines of all others go. DataFrame expressions only.

Defined cases: a null text stays null; a text of fewer lines than a window, or empty, stays as it is; windows of
blank lines alone don't count; null ids come first in the order of places; rows that repeat id and text are one
document and are all changed alike; an empty table gives an empty table; the columns added replace input columns
of the same name; the text of a document all of whose lines go is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written


def _lines(text_col: str):
    return F.split(F.col(text_col), "\n", -1)


def windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``_k1, _k2, pos, h1, h2`` of every window that isn't blank."""
    keyed = row_key(df.select(id_col, text_col), id_col, text_col).withColumn("_l", _lines(text_col))
    n = F.size("_l") - window + 1
    parts = lambda i: [F.element_at("_l", i + k) for k in range(1, window + 1)]

    def one(i):
        line = parts(i)
        blank = F.concat(*(F.trim(x) for x in line)) == ""
        return F.when(~blank, F.struct(i.alias("pos"), F.xxhash64(*line).alias("h1"), F.xxhash64(F.lit("w"), *line[::-1]).alias("h2")))

    found = keyed.where(n > 0).select("_k1", "_k2", F.explode(F.transform(F.sequence(F.lit(0), n - 1), one)).alias("w"))
    return found.where("w is not null").select("_k1", "_k2", "w.pos", "w.h1", "w.h2")


def later_places(found: DataFrame) -> DataFrame:
    """The windows of ``found`` whose content stands at an earlier place too.

    First places are aggregated before the shuffle and written, so that the join has a plain exchange on
    either side and a window that a third of all documents hold is split at run time.
    """
    place = F.struct("_k1", "_k2", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    return found.join(written(first, "windows"), ["h1", "h2"]).where(place > F.col("first")).select("_k1", "_k2", "pos")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``df`` with the text that is left, and ``n_lines`` (before) and ``n_removed``."""
    later = later_places(windows(df, id_col, text_col, window))
    per_doc = later.distinct().groupBy("_k1", "_k2").agg(F.collect_list("pos").alias("_starts"))
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    out = row_key(df.select(kept), id_col, text_col).join(per_doc, ["_k1", "_k2"], "left")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + window - 1)))))
    out = out.withColumns({"_l": F.when(F.col("_starts").isNotNull(), _lines(text_col)), "_c": covered})
    edge = lambda n: F.array(n.cast("int"))
    gaps = F.zip_with(F.concat(edge(F.lit(-1)), "_c"), F.concat(F.col("_c"), edge(F.size("_l"))), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("n")))
    left = F.flatten(F.transform(F.filter(gaps, lambda g: g["n"] > 0), lambda g: F.slice("_l", g["start"], g["n"])))
    text = F.when(F.col("_starts").isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", left))
    n_lines = F.when(F.coalesce(F.length(text_col), F.lit(0)) == 0, 0).otherwise(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1)
    removed = F.when(F.col("_c").isNull(), 0).otherwise(F.size("_c")).cast("long")
    return out.withColumn("n_lines", n_lines.cast("long")).withColumns({text_col: text, "n_removed": removed}).select(*kept, "n_lines", "n_removed")
