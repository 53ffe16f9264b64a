"""Connected components over a distributed table of links, by alternating large and small stars.

The links stay in Spark: minima are partial aggregates, so a vertex with very many neighbours is no hot spot there. They are
cut by a checkpoint in the shared folder before they are joined back, so that the engine sees two plain shuffles and can split
the links of such a vertex over several tasks. Each round is cut by a checkpoint as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, root): every id of a link with the smallest id it reaches; links are symmetric, self-links count nothing."""
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    edges = checkpoint(edges)
    before = None
    while True:
        # large star: the larger neighbours of a vertex are linked to its smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a vertex and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        edges = checkpoint(small.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
