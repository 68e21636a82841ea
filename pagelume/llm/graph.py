"""Connected components of an edge table, with alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component. Nodes of any orderable type.

    Each round links the larger neighbours of a node to its least neighbour, then the smaller ones; the number of rounds
    grows with the logarithm of the longest path. A node's neighbours are never gathered: the least one is an aggregate
    (partial sums first), a written table, so that the join that brings it back is one that Spark may split where a node has
very many neighbours. Every round is a written table.
    """
    def state(table: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(table.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first())

    current = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(current)
    for _ in range(most_rounds):
        # large star: every larger neighbour of x is linked to the least of x and its neighbours
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = scratch.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: x's smaller neighbours and x are linked to the least of them
        lower = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.table(small, "edges")
        scratch.drop(current, least, large, lower)
        current, now = after, state(after)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("v")).distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
