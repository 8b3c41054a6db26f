"""Connected components of a large graph, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marlstone.storage import materialize, release

#: A node counts as hot from this many edges on, and from its share of all edges on: 1 in HOT_NODES.
HOT = 1000
HOT_NODES = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: each node first hands its
    larger neighbours, then its smaller ones, to the smallest node it knows.
    The number of edges never grows, and the number of rounds is about the
    logarithm of the longest path. Minima are pre-aggregated and a hot node's row is
    broadcast, so that a large component needs no large task.
    Each round is written to the shared folder. An edge with a null end is dropped.
    """
    current = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _join_least(both.where("b > a"), least, mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # the smallest neighbour of each node keeps its place, the others move to it
        large = materialize(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _join_least(large, least, mark[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = materialize(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        release(large)
        after = _mark(following)
        release(current)
        current = following
        if after == mark:
            break
        mark = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _join_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` joined with ``least`` (a, m, n), where n is a node's number of edges.

    A node with a large share of all ``total`` edges would make a large task. There are 2 HOT_NODES of
    these at most, so their rows are broadcast, and their edges stay where they are.
    """
    most = max(HOT, total // HOT_NODES)
    hot = least.where(F.col("n") > most).select("a", "m")
    if not hot.limit(1).count():
        return edges.join(least.select("a", "m"), "a")
    cold = edges.join(F.broadcast(hot.select("a")), "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a")
    return cold.unionByName(edges.join(F.broadcast(hot), "a").select(*cold.columns))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32))).first())
