"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def connected_components(links: DataFrame, a: str = "a", b: str = "b", node: str = "node", component: str = "component_id") -> DataFrame:
    """Each linked node and the smallest node reachable from it.

    Rounds of large and small stars: every node first hands its larger neighbours, then its smaller
    ones, to the least node around it. Each round is written to the shared folder; the rounds end
    when nothing moves. No links are brought to the driver, and a hub's links meet only in minima
    (combined before the shuffle) and in a join that can be split. Nulls and self-links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = write_table(edges, "links"), None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if tuple(state) == before or state["n"] == 0:
            # every node but the least has one edge now
            roots = edges.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
            return edges.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(roots)
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = write_table(small.where("u <> v").distinct(), "links")
