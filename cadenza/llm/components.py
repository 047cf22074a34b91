"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to a neighbourhood's smallest node: large-star moves a node's larger neighbours,
small-star its smaller ones.  Both are one minimum per node (combined before the shuffle) and one join back; no
neighbourhood is ever gathered.  The minima are dealt anew before the join (`rebalance`): adaptive execution splits a hot
node's rows only where neither side's partitioning is an aggregate's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import drop, stored


def _digest(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
    return r.n, r.x or 0, r.s or 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).hint("rebalance")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low.hint("rebalance"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 100) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    `edges` has two columns of one integer type; nulls and self-loops are ignored, repeats and either direction allowed.
    An empty table gives an empty table.  Raises if `limit` rounds don't suffice (the number needed grows with the
    logarithm of the number of nodes).
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(e)
    if not seen[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(limit):
        new = stored(_small_star(_large_star(e)), "edges")
        drop(e)
        e, now = new, _digest(new)
        if now == seen:
            roots = e.select(F.col("v").alias("node")).distinct()
            return stored(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "labels")
        seen = now
    raise RuntimeError(f"components did not converge in {limit} rounds")
