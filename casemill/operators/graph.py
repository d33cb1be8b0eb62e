"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.runtime import cut


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node of its connected component.

    Edges with a null end are left out, loops keep their node. Alternates large-star and small-star rounds, each a
    group-by on nodes and each cut to the shared folder, until every edge leads to its smallest node: about log2 of the
    longest path. Nothing but one row per round reaches the driver. An empty table gives no rows.
    """
    raw = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where("u is not null and v is not null")
    nodes = raw.select(F.col("u").alias("node")).union(raw.select("v")).distinct()
    links = cut(raw.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _stars(links):
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(links.join(low, "u").where("m = v").select("u", "v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        links = cut(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none: then the links name the components."""
    ends = links.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("down"), F.lit(0).alias("up")).union(links.select("v").distinct().select("v", F.lit(0).cast("bigint"), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or down = 1 and up = 1")
    return odd.isEmpty()
