"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _stamp(pairs: DataFrame) -> tuple:
    """Count and order-free checksum of a set of pairs."""
    h = F.xxhash64("hi", "lo")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))),
                           F.sum(F.shiftrightunsigned(h, 33))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): every node that has an edge, with the smallest node it reaches.

    Self-loops, repeated and reversed edges change nothing; rows with a null end are left out; no edges give no rows.
    Each round is written to the shared folder. A hub's edges are reduced to a minimum by partial aggregation,
    and the joins that hand it back are ones whose large partitions adaptive execution splits.
    """
    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
                   "edges")
    before = _stamp(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("lo"), F.least("hi", "m").alias("m"))
        # large star: neighbours above a node are tied to the least node around it
        large = (pairs.join(least, "lo").where("hi <> m").select("hi", F.col("m").alias("lo")).distinct())
        # small star: neighbours below a node, and the node, are tied to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
        pairs = stored(small, "stars")
        after = _stamp(pairs)
        if after == before:
            break
        before = after
    return (pairs.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
            .unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()))
