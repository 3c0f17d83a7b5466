"""Connected components of a distributed edge list.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each round replaces every edge by
edges to the smallest known neighbour, until the edge list is a forest of stars
whose centres are the smallest members. Edges never leave the executors; each
round ends in a checkpoint in the shared folder, so that a lost executor
re-reads one round. A node with very many neighbours only meets partial
aggregates and a join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campusledger.llm.common import release, stored


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (two columns of any orderable type) -> ``(node, root)``.

    ``root`` is the smallest node reachable. Self links and nulls are ignored;
    nodes without an edge to another node do not appear.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(a.isNotNull() & b.isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = stored(e, "links")
    seen = _signature(e)
    while seen[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, e = e, stored(small, "links")
        release(before)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
