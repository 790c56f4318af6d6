"""Connected components of a stored edge table, by repeated contraction.

In each round every vertex points to the neighbour (or itself) that comes first by a hash of its number and the
round; edges are replaced by those between the vertices pointed to, and edges inside one vertex vanish. A star is
gone in one round, a path loses a constant share of its vertices in each. All of it is joins and grouped minima, of
which each round stores the results in the shared folder; only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import runtime


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of ``edges`` (u, v): equal labels exactly where edges connect."""
    edges = runtime.store(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    labels = runtime.store(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("label", F.col("id")), "cc-labels")
    turn = 0
    while not edges.isEmpty():
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(order("v")).alias("near"))
        points = runtime.store(best.select("u", F.least(F.col("near"), order("u"))["id"].alias("to")), "cc-points")
        as_u = points.select("u", F.col("to").alias("to_u"))
        as_v = points.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        moved = edges.join(as_u, "u").join(as_v, "v").where("to_u <> to_v")
        after = runtime.store(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "cc-edges")
        relabelled = labels.join(points.select(F.col("u").alias("label"), "to"), "label", "left")
        new = runtime.store(relabelled.select("id", F.coalesce("to", "label").alias("label")), "cc-labels")
        for old in (edges, labels, points):
            runtime.drop(old)
        edges, labels, turn = after, new, turn + 1
    runtime.drop(edges)
    return labels
