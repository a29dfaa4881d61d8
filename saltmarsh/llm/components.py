"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut


def _largest_to_least(edges: DataFrame) -> DataFrame:
    """Large star: tie each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Small star: tie a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (columns a, b of one orderable type) that are not the least of their component, with that least.

    Returns node and root; the roots themselves and nodes without edges have no row. The number of
    rounds grows with the logarithm of the longest path. Each node's neighbours are only ever reduced
    to their minimum or passed on row by row, so a node with very many neighbours is no special case.
    Edges with a null end, and loops, do not count.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("_ok")).where("_ok and a <> b").select("a", "b").distinct())
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not found["n"] or (found["n"], found["x"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (found["n"], found["x"])
        now = cut(_smaller_to_least(_largest_to_least(now)))
