"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.llm.storage import written

EDGES_PER_TASK = 100_000
"""Edges of a round, about, that one task writes; rounds have no more edges than the first."""


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (``a``, ``b`` long); the component is its least node.

    A round joins each node's neighbours to the least one near it. Minima are combined before the
    shuffle, so a node with very many neighbours costs a row per task; the number of rounds grows
    with the logarithm of the longest path. A round is written to the shared folder, in files of a size that
    follows the edges, and read from there. Repeated edges do no harm; an edge from a node to itself is dropped.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "graph-edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before, now = None, _state(edges)
    tasks = now[0] // EDGES_PER_TASK + 1
    while now != before:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct().coalesce(tasks), "graph-edges")
        before, now = now, _state(edges)
    return nodes.join(edges, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
