"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, written


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a``, ``b``): the smallest node it is linked with.

    Each round every node takes the smallest label around it, then its label's label; labels fall
    along chains of any length in a logarithmic number of rounds in practice. Minima are taken before the
    shuffle; each round is written to the shared folder and the one before it removed. A node or label that very many rows share
    is met in joins alone, from written tables by plain exchanges, which run-time planning splits.

    Defined cases: loops and repeated edges don't matter, edges with a null end are left out, and no edges give an empty table.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        near = labels.join(around, "node").select("node", "label", F.least("label", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("label").alias("top"))
        jumped = written(near.join(up, "m").select("node", F.least("m", "top").alias("label"), (F.least("m", "top") < F.col("label")).alias("moved")), "labels")
        free(labels)
        labels = jumped.select("node", "label")
        labels._scratch = jumped._scratch
        if jumped.where("moved").isEmpty():
            free(both)
            return labels
