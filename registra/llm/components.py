"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import erase, new_path, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every node's smallest neighbour (or the node itself) comes from an aggregation that combines
    before the shuffle; a hub's edges meet it in a join that Spark can split."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) but the roots themselves; root is the smallest node that can be reached.

    Each round is written to the shared folder, so the lineage stays short and lost executors cost one round; the round
    before is erased. Rounds go on until one changes nothing."""
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a <> b").distinct()
    before, last = None, None
    while True:
        path = new_path(spark, "edges")
        edges = written(edges if last is None else _star(_star(edges, large=True), large=False), "edges", path)
        if last is not None:
            erase(spark, last)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, last = now, path
