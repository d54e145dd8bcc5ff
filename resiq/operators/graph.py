"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resiq.session import cut


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each node's component. Null ends and loops are no links;
    no links give no rows.

    Alternating star operations (Kiveris et al., "Connected components in MapReduce and beyond", 2014):
    each node's larger neighbours are tied to its smallest, then its smaller ones. Rounds grow with the
    logarithm of the nodes, links never multiply, and a node of very many links is an aggregate and an
    equi-join, never a group in one task. Each round is cut with a checkpoint."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node's smaller neighbours, and itself, to the smallest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
