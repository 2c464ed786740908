"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.session import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Nodes that occur in ``edges`` with the smallest node of their component: (node, component).

    Edges with a null end or equal ends name no link; a node seen only in self-loops is its own
    component. Each round is two grouped minima and two equi-joins on slim rows; lineage is cut by
    a reliable checkpoint, and the caller's plan runs once. A star's centre may hold any share of the edges: the minima are combined
    before the shuffle and the joins carry one row per node on one side, which AQE can split.
    """
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    given = checkpoint(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = given.where("u <> v")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
