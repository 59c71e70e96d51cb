"""Connected components of a graph too large for one machine, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: Edges up to which a table of their nodes' minima is broadcast (16 bytes each).
BROADCAST_EDGES = 500_000
#: More rounds than any graph needs (they grow with the logarithm of the longest path, squared at worst).
MAX_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of edges (a, b).

    Alternating stars: each node hands its neighbours to the smallest node it knows, larger
    neighbours first, then smaller ones; the edges end up as one star per component.  Per
    round a node's minimum is combined before the shuffle and joined back to its edges: by
    broadcast while there are few edges, so that a hub's stay where they are, else by adaptive
    joins that split hubs.  No task gathers a neighbourhood.  Every round ends in the shared
    folder.  Null ends and loops are ignored.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    before, few = None, e.count() <= BROADCAST_EDGES
    for _ in range(MAX_ROUNDS):
        large = cut(_large_star(e, few), "edges")
        small = cut(_small_star(large, few), "edges")
        discard(e, large)
        e = small
        # a round that changes nothing leaves the same set of edges: count and two sums of hashes
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before or now[0] == 0:
            break
        before, few = now, now[0] <= BROADCAST_EDGES
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _minima(least: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(least) if few else least


def _large_star(e: DataFrame, few: bool) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = e.select(F.col("v").alias("k"), F.col("u").alias("w"))  # each edge seen from its smaller end
    return larger.join(_minima(least, few), "k").select(F.col("w").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, few: bool) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(_minima(least, few), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
