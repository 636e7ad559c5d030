"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.llm import _scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of edges ``a, b``; component is the least node.

    Rounds of large-star and small-star until the edges stay as they are; each
    round shuffles the edges twice and is written to the shared folder. Nulls
    and loops are ignored.
    """
    w = Window.partitionBy("a")
    now = _scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.select("b", F.least("a", F.min("b").over(w)).alias("m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.select("a", "b", F.min("b").over(w).alias("m"))
        small = least.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        then = _scratch.write(small, "cc")
        _scratch.drop(now)
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
