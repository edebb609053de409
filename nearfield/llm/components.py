"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Neighbourhood minima are partial aggregates joined back, so a node with very many links is no task of its own.
Each round is checkpointed to the shared folder. It ends with stars around least ids, which needs no round more to be seen.
Joins are merge joins at any size: a broadcast costs the driver memory and a thread each, in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import shared_dir


def _settled(edges: DataFrame) -> bool:
    """If edges from greater to lesser ids are stars: no node has two lesser neighbours, or a lesser and a greater one."""
    ends = edges.select("a", F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    nodes = ends.groupBy("a").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater"))
    return not nodes.where("lesser + greater > 1 and lesser > 0").agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (64-bit ids). Returns node, comp: every node with a link to another, and the least id of its component."""
    shared_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        edges = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
