"""Connected components of a graph that lies in tables.

Edges are rewired towards the smallest node they reach, alternately for the
larger neighbours of each node and for the smaller ones, until every node hangs
on the smallest node of its component.  The number of edges never grows, no
node's neighbours are gathered in one place, and each round is written to the
shared folder, so that a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewake.staging import Stage


def _rewire(pairs: DataFrame) -> DataFrame:
    """Each (node, other) pair becomes (other, smallest of node and all its others); ``pairs`` must lie in a table."""
    least = pairs.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return pairs.join(least, "node").select(F.col("other").alias("node"), F.col("least").alias("other"))


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("node <> other").select(
        F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")
    ).distinct()


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root) for every node that has an edge to another, from edges (node, other) of one ordered type."""
    edges = stage(_canonical(edges.select("node", "other")), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        # larger neighbours move to the least one of their neighbour
        larger = _rewire(both).where("node > other")
        edges = stage(_canonical(larger.union(_least_of_each(both))), "edges")
        # smaller neighbours, and the node itself, move to the least one
        smaller = _rewire(edges).where("node > other")
        edges = stage(_canonical(smaller.union(_least_of_each(edges))), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("node", F.col("other").alias("root"))
        before = now


def _least_of_each(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node").agg(F.min("other").alias("other")).where("other < node")
