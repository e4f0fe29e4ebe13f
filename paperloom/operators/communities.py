"""Communities of a weighted graph by modularity: parallel local moves, then contraction, until nothing is gained.

In a round every vertex looks at the communities of its neighbours at once and moves to the one of greatest gain. Even
rounds move to smaller labels only and odd ones to larger labels, so that no two vertices change places. A pair of
rounds that doesn't raise modularity is taken back and ends the level; then each community becomes a vertex, its inner weight a
loop. All state is in tables of vertices and edges; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage

#: Gains and rises of modularity up to this are taken for rounding.
LEAST = 1e-9


def two_way(edges: DataFrame, weight: str) -> DataFrame:
    """(a, b, w) in both directions, parallel edges added up, a loop as one row of twice its weight."""
    rows = edges.where(F.col(weight) > 0).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).cast("double").alias("w"))
    return rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity(both: DataFrame, labels: DataFrame) -> float:
    """Of the partition ``labels`` (v, c) of a two-way graph; 0 without edges."""
    named = both.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
    each = named.groupBy("ca").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    row = each.agg(F.sum("total").alias("m"), F.sum("inner").alias("i"), F.sum(F.col("total") * F.col("total")).alias("s")).first()
    return row["i"] / row["m"] - row["s"] / row["m"] ** 2 if row["m"] else 0.0


def moved(both: DataFrame, degrees: DataFrame, labels: DataFrame, whole: float, up: bool) -> DataFrame:
    """``labels`` (v, c) after one round."""
    held = labels.join(degrees, "v")
    totals = held.groupBy("c").agg(F.sum("k").alias("total"))
    near = both.where("a <> b").join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("v"), "c").agg(F.sum("w").alias("w"))
    stay = held.select("v", "c", F.lit(0.0).alias("w"))  # its own community, whether a neighbour is in it or not
    offers = near.unionByName(stay).groupBy("v", "c").agg(F.sum("w").alias("w")).join(totals, "c").join(held.select("v", "k", F.col("c").alias("own")), "v")
    rest = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
    offers = offers.withColumn("gain", F.round(F.col("w") - F.col("k") * rest / whole, 9))
    allowed = (F.col("c") > F.col("own")) if up else (F.col("c") < F.col("own"))
    order = Window.partitionBy("v").orderBy(F.desc("gain"), F.col("c") != F.col("own"), "c")
    best = offers.where(allowed | (F.col("c") == F.col("own"))).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    return cut_lineage(best.select("v", "c"))


def settled(both: DataFrame) -> tuple[DataFrame, bool]:
    """(v, c) after rounds of one level, and whether any vertex moved for good."""
    degrees = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")))
    labels = degrees.select("v", F.col("v").alias("c"))
    whole, best, changed = degrees.agg(F.sum("k")).first()[0] or 0.0, modularity(both, labels), False
    while whole:
        now = moved(both, degrees, moved(both, degrees, labels, whole, False), whole, True)
        value = modularity(both, now)
        if value <= best + LEAST:
            break
        labels, best, changed = now, value, True
    return labels, changed


def communities(vertices: DataFrame, edges: DataFrame, weight: str = "chi", id_col: str = "topic") -> DataFrame:
    """(vertex, community): the least vertex of each one's community; vertices without an edge of positive weight are their own."""
    both = cut_lineage(two_way(edges, weight))
    found = cut_lineage(vertices.select(F.col(id_col).alias("v")).distinct().withColumn("c", F.col("v")))
    while True:
        labels, changed = settled(both)
        if not changed:
            break
        found = cut_lineage(found.join(labels.toDF("c", "d"), "c", "left").select("v", F.coalesce("d", "c").alias("c")))
        named = both.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
        both = cut_lineage(named.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    least = found.groupBy("c").agg(F.min("v").alias("least"))
    return found.join(least, "c").select(F.col("v").alias(id_col), F.col("least").alias("community"))


def community_table(vertices: DataFrame, edges: DataFrame, weight: str = "chi", id_col: str = "topic") -> DataFrame:
    """(vertex, community, size, modularity): the modularity is that of the whole partition."""
    found = cut_lineage(communities(vertices, edges, weight, id_col))
    value = modularity(two_way(edges, weight), found.toDF("v", "c"))
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "community").select(id_col, "community", "size", F.lit(value).alias("modularity"))
