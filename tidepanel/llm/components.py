"""Connected components of a distributed edge list by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.common import store


def _large(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())  # two numbers


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that the node can reach; nodes that are their own root don't appear.

    ``edges`` has columns a and b of one type in any order and any number; null ends and loops are ignored. Each round is written to
    the shared folder; there are about as many as the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = store(edges, "edges"), None
    while (new := _mark(edges)) != mark:
        mark = new
        edges = store(_small(_large(edges).distinct()).where("a <> b").distinct(), "edges") if new[0] else edges
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
