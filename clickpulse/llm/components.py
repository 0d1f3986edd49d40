"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouping and a join on node keys; a node with very many links is one row of the grouped side, which is
written first, so that Spark can split the other side. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether each node either points to one other node or is pointed to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return sums.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: columns ``u, v`` of one orderable type. Returns ``node, root``: the smallest node of its component.

    Nodes without a link to another node are left out. Nulls, loops, repeated and reversed links are ignored.
    """
    edges = cut(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), short=True)
    while not _stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), short=True)
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), short=True)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), short=True)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), short=True)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
