"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of (a, b) with the least node it is connected to.

    A large star hangs all larger neighbours of a node on its least neighbour, a small star all smaller
    ones; their alternation ends in stars about each component's least node, in a number of rounds
    logarithmic in the size of components. Every round is a written table.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        around = _both(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(small, "a")
        before, edges = edges, written(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        discard(before, down)
        now = _state(edges)
        if now == state:
            break
        state = now
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
