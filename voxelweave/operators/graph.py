"""Connected components over an edge table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.session import cut

#: From so many edges on, the minima of a round are written out before they meet the edges.
HOT_EDGES = 200_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, component.

    Alternating large-star and small-star (Kiveris et al. 2014): each round links every node to the smallest of its
    neighbourhood, so a component of n nodes ends as a star after O(log^2 n) rounds whatever its shape. The minimum of
    a neighbourhood is a partial aggregate. Where there are more than HOT_EDGES edges it is written out before it meets them
    again: a join with an aggregate that is still part of the plan keeps its partitions whole, one between two tables is
    split by adaptive execution where a hot node gathers its neighbours. Each round is cut from its lineage on the shared folder.

    Self loops are kept as nodes of their own; rows with a null end are ignored; repeated edges count once; an empty
    table gives an empty one.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes_alone = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    e = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, n = None, e.count()
    while n:
        kept = cut if n > HOT_EDGES else lambda frame: frame
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        low = kept(low)
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v").distinct())
        # small star: neighbours that are smaller, and the node itself, go to the smallest of them
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(low.hint("merge"), "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, n = seen, seen[0]
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = star.union(roots)
    alone = nodes_alone.join(found.select("node").hint("merge"), "node", "left_anti")
    return found.union(alone.select("node", F.col("node").alias("component"))).distinct()
