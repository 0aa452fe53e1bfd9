"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronocell.sources.scratch import Scratch


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every upper end has one edge and is no lower end: what a round leaves as it is."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = edges.select(ends.alias("end")).groupBy("end.id").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return nodes.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` for every id in ``links`` (``a, b``); the component is its smallest id.

    Large star links every neighbour above a node to the node's smallest neighbour, small
    star every neighbour below; both keep components and together they reach stars in
    O(log^2 n) rounds.  Each round is a shuffle of at most the number of links, written to
    shared scratch.  Equal links, self links and an empty table are fine.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # A node and its neighbours below all go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array("u", "v")).alias("u")
        after = scratch.keep(large.join(low, "u").select(moved, F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        scratch.drop(edges)
        edges = after
    heads = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    out = scratch.keep(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads), "components")
    scratch.drop(edges)
    return out
