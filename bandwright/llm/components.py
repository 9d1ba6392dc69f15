"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.sources.session import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hangs neighbours of each node on the least of them: the smaller ones, or the larger.

    The least neighbour is an aggregate and comes back by a join, which adaptive execution
    splits at hot nodes; no neighbour list is ever built.
    """
    if small:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = ways.join(least, "u")
    if small:
        pairs = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u"), F.col("m"))
        )
    else:
        pairs = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return pairs.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge down to a root."""
    ends = [F.struct(F.col(end).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("in")) for end, out in (("a", 1), ("b", 0))]
    # One shuffle, as every round asks.
    nodes = edges.select((F.col("a") < F.col("b")).alias("upward"), F.inline(F.array(*ends))).groupBy("node").agg(
        F.sum("out").alias("out"), F.max("in").alias("in"), F.bool_or("upward").alias("upward"))
    return nodes.where(F.col("upward") | (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label: the least node reachable.

    Alternates large and small stars (Kiveris et al. 2014) until the edges form stars.
    Edges with a null end and loops are ignored. Each round is written to the shared
    folder, which cuts the lineage.
    """
    state = written(edges.select("a", "b").dropna().where("a <> b").distinct(), "edges")
    while not _settled(state):
        state = written(_stars(_stars(state, small=False), small=True), "edges")
    labels = state.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label"))
    return labels.union(labels.select("label", "label").distinct())
