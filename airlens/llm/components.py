"""Connected components of a graph given as links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.work import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: root is the smallest node that it can reach.

    Each round sends every node's larger neighbours to the smallest one it sees, then does the same for the smaller
    neighbours (large-star and small-star). Paths shorten to half or less per round, a star stays a star, and what is
    grouped is only ever a minimum. Ends when no link changes. No links: no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    seen = _digest(edges)
    while True:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("low")).withColumn("low", F.least("low", "v"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("low").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v")
        edges = written(small.where("u <> low").select(F.col("u").alias("v"), F.col("low").alias("u")).union(low.select("v", F.col("low").alias("u"))).distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal when nothing changed."""
    h = F.xxhash64("v", "u")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND((1 << 40) - 1))).first())
