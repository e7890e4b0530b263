"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import keep


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 31)))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``; the root is the smallest node reachable.

    Every round joins each node's edges with the smallest neighbour, an aggregate that Spark combines
    before its shuffle; no neighbourhood is gathered. Rounds end once the edges no longer change.
    """
    edges = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = _print(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        edges = keep(small.distinct(), "edges")
        now = _print(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
