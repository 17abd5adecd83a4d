"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round aggregates a minimum per node (combined map-side, so a node with very many neighbours
costs one partial row per task) and joins it back; minima are written out first, so that both join
sides are plain exchanges and adaptive execution can split a hub's rows. The number of rounds grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Nulls and self loops link nothing; repeated edges count once; no edges gives an empty table.
    Nodes may be of any orderable type.
    """
    u, v = F.col(src), F.col(dst)
    edge = materialize(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct(),
        "cc",
    )
    for _ in range(max_rounds):
        # large-star: neighbours above u go to the least of u and its neighbours
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # small-star: u and its smaller neighbours go to the least of them
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        joined = large.join(low2, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        new = materialize(small, "cc")
        # stars only: no node is both a leaf and a centre, and each leaf has one centre
        leaves = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        chained = leaves > 1 or not new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").isEmpty()
        for t in (edge, low, large, low2):
            discard(t)
        edge = new
        if not chained:
            break
    else:
        raise RuntimeError("connected components did not settle")
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edge.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
