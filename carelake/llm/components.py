"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, u != v, in either direction -> (node, root): every node of a link with the least node
    of its component. A node of very many links is no hot group: minima are combined before the shuffle
    and the joins on it can be split. No links give no rows."""
    edges = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = _state(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
                  .unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        edges = save(big.where("u != v").distinct(), "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u")
        small_ = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v") \
                     .unionByName(least.select("u", F.col("m").alias("v")))
        edges = save(small_.distinct(), "small-star")
        now = _state(edges)
        if now == last:
            break
        last = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
