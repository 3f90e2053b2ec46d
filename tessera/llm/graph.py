"""Connected components by alternating stars, all on the cluster.

Kiveris et al., "Connected Components in MapReduce and Beyond": a large star links the larger neighbours of every
node to the smallest of its closed neighbourhood, a small star links the smaller neighbours and the node itself to
the smallest of them. Alternated, the edges become stars around the least node of each component. Nodes are
compared by a hash of their ids, so an unlucky order of ids (a long chain) cannot make the rounds many: they grow
with the logarithm of the chain. Every edge table is written to the shared folder and the one before is deleted, so
a lost executor costs one table at most; minima are combined before the shuffle, and the joins of skewed keys may be
split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), v before u in order, distinct -> the same after one star: each node's neighbours meet their least."""
    ahead = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    near = ahead.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m"))) if large else ahead
    least = near.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
    if large:
        moved = near.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        moved = near.join(least, "n").where("m > least").select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """edges(a long, b long) -> settled table (node, root): root is the same node of the component for all its nodes.

    Self loops and repeated edges are harmless; an empty edge table gives an empty result. Nodes without
    edges do not appear. rounds, if given, gets one entry for each round.
    """
    key = lambda c: F.struct(F.xxhash64(c, F.lit(7)).alias("h"), F.col(c).alias("id"))
    pairs = edges.where("a <> b").select(key("a").alias("a"), key("b").alias("b"))
    e = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    shape = None
    while True:
        large = settle(_star(e, True), "large")
        forget(e)
        e = settle(_star(large, False), "small")
        forget(large)
        if rounds is not None:
            rounds.append(1)
        # done when a round changes nothing: the number of edges and two sums over their hashes stay as they are
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("v", "u").cast("long"))).first()
        if now == shape:
            break
        shape = now
    roots = e.select(F.col("u.id").alias("node"), F.col("v.id").alias("root"))
    out = settle(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    forget(e)
    return out
