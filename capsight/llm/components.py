"""Connected components by alternating large-star and small-star (Kiveris et al. 2014).

Both steps are a map-side combined minimum per node and an equi-join back on the node, so a hub
with any share of all edges is neither collected nor expanded into pairs. Each round is written
to the shared folder; the loop stops when a round leaves the edges as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsight.llm.spark import discard, written

MAX_ROUNDS = 40


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is hung on the least of u and its neighbours. ``edges``: u > v, distinct."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # v < u for the larger end only: joining the directed edges (u > v) on their smaller end suffices
    return (
        edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
        .select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """The neighbours below u, and u, are hung on the least of them. ``edges``: u > v, distinct."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free sums: equal for equal sets of edges."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(h, "v", "u"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge; root is the least node reachable.

    Nulls and self-edges are left out; repeated edges and either direction count once. An empty
    table gives an empty one.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a is not null and _b is not null and u <> v").select("u", "v").distinct(),
        "edges",
    )
    before = _digest(now)
    for _ in range(MAX_ROUNDS):
        last, now = now, written(_small_star(_large_star(now)), "edges")
        discard(last)
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )
