"""Connected components of a large edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxrank.session import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of the edges (u, v): root is the least node of its component; roots too are listed.

    Each step joins the edges with the least neighbour of each node, a table with one
    row a node, and cuts the lineage with a written table.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "stars")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.select("u", F.col("v").alias("root")).unionByName(roots)
