"""Connected components by alternating large-star and small-star rounds, each a pair of joins and a written table.

Every round moves edges towards the smallest node of their neighbourhood; a hub's neighbours are never gathered, as its
smallest neighbour is an aggregate that is joined back, salted where the hub has many edges. The edges are as many as before or
fewer after each round. Null ends are no edges. No edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, salted_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return salted_join(both.where("b > a"), low, "a", hot_keys(both, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = scratch.stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = salted_join(down, low, "a", hot_keys(down, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """edges: a, b (long). Returns node, root: the smallest node that each node with an edge reaches."""
    old, before = Scratch(), None
    now = old.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        new = Scratch()
        now = new.stage(_small_star(_large_star(now), old), "edges")
        old.clear()
        old = new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
