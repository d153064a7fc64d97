"""Connected components of an undirected edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_hot
from .store import Scratch, written


def _stars(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """Point every neighbour of a node at the least node that it knows: larger neighbours (large star) or smaller ones (small star).

    Only the least id is kept for each node, so that a node with many neighbours needs no list of them, and its edges are dealt out to several tasks.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    hung = join_hot(both, least, ["u"], count="degree", total=n_edges, spread=["v"])
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), where component is the least node that can be reached.

    Nulls and loops are ignored; an edge may be given in either direction and more than once.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), "edges")
    for _ in range(max_rounds):
        n_edges = edges.count()
        edges = scratch.written(_stars(scratch.written(_stars(edges, True, 2 * n_edges), "large"), False, n_edges), "stars")
        # Settled once every edge is the only one of its larger end, and ends in a root.
        ends = edges.groupBy("u").agg(F.count("*").alias("n"))
        if edges.join(ends.withColumnRenamed("u", "e"), F.col("v") == F.col("e"), "left_semi").isEmpty() and ends.where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
    scratch.drop()
    return found
