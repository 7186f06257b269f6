"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenads.llm.tables import stored


def _least(pairs: DataFrame, keep) -> DataFrame:
    """Link each kept neighbour ``v`` of ``u`` to the least of ``u`` and all its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _hooked(links: DataFrame) -> DataFrame:
    """The same components with fewer links: each node keeps the one to its least neighbour,
    and every other link is drawn between the nodes that its ends keep. In a crowd of
    nodes that all know each other nearly all of these become one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hooks = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "hooks")
    one, other = (hooks.select(F.col("u").alias(end), F.col("m").alias(to)) for end, to in (("u", "x"), ("v", "y")))
    drawn = links.join(one, "u").join(other, "v").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    kept = hooks.select("u", F.col("m").alias("v"))
    return stored(drawn.unionByName(kept).where("u > v").distinct(), "links")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is its least node.

    Large-star and small-star rounds until nothing changes; each round is a table
    in the shared folder, so lineage stays short and a lost executor costs one
    round. Nothing but one count and one hash sum reaches the driver. Self-links,
    repeated edges and null ends do no harm; no edges give no rows.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links, before = _hooked(stored(links, "links")), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.col("v") > F.col("u")).where("u > v").distinct()
        down = large.unionByName(large.select("u", F.col("u").alias("v")).distinct())
        small = _least(down, F.lit(True)).where("u > v").distinct()
        links = stored(small, "links")
