"""Topic relationships: memberships, pairs, chi-square, degrees, components, centrality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.vectors import chi_square
from paperloom.session import cut_lineage


def major_topics(distribution: Column, threshold: float) -> Column:
    """Indices of the components of at least ``threshold``."""
    placed = F.transform(distribution, lambda v, i: F.when(v >= threshold, i))
    return F.filter(placed, lambda i: i.isNotNull())


def topic_counts(docs: DataFrame, topics_col: str = "topics") -> DataFrame:
    """(topic, docs): documents that each topic occurs in."""
    return docs.select(F.explode(topics_col).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("docs"))


#: Cells of the table of rows by topics that pairs are counted from at once, and topics whose pairs are counted at once.
CELLS, ABREAST = 4_000_000, 512


def _pairs(lists: pa.ListArray) -> Iterator[list[pa.Array]]:
    """src, dst and cnt of some rows' distinct topics, from the product of their table with itself."""
    names = pc.unique(lists.flatten())
    if len(lists) > 1 and len(lists) * len(names) > CELLS:
        half = len(lists) // 2
        yield from _pairs(lists.slice(0, half))
        yield from _pairs(lists.slice(half))
        return
    names = names.take(pc.array_sort_indices(names, null_placement="at_end"))
    held = np.zeros((len(lists), len(names)), np.float32)  # counts up to CELLS are exact
    held[pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), value_set=names).to_numpy()] = 1
    for first in range(0, len(names), ABREAST):
        both = np.triu(held[:, first : first + ABREAST].T @ held, first + 1)
        src, dst = np.nonzero(both)
        if len(src):
            yield [names.take(pa.array(src + first)), names.take(pa.array(dst)), pa.array(both[src, dst].astype(np.int64))]


def pair_counts(docs: DataFrame, topics_col: str = "topics") -> DataFrame:
    """(src, dst, cnt) with src < dst: documents that two topics occur in together. A task sums up the pairs of its rows first."""
    distinct = docs.select(F.array_distinct(topics_col).alias("topics"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for made in _pairs(batch.column("topics")):
                yield pa.RecordBatch.from_arrays(made, ["src", "dst", "cnt"])

    kind = distinct.schema["topics"].dataType.elementType.simpleString()
    return distinct.mapInArrow(run, f"src {kind}, dst {kind}, cnt long").groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def chi_square_edges(docs: DataFrame, topics_col: str = "topics", correction: str = "signed") -> DataFrame:
    """(src, dst, cnt, src_docs, dst_docs, chi); the total counts documents without a topic too."""
    counts = topic_counts(docs, topics_col)
    total = docs.agg(F.count(F.lit(1))).scalar()
    edges = pair_counts(docs, topics_col)
    edges = edges.join(counts.toDF("src", "src_docs"), "src").join(counts.toDF("dst", "dst_docs"), "dst")
    return edges.select("src", "dst", "cnt", "src_docs", "dst_docs", chi_square(F.col("cnt"), F.col("src_docs"), F.col("dst_docs"), total, correction).alias("chi"))


def interesting(edges: DataFrame, threshold: float = 19.5) -> DataFrame:
    return edges.where(F.col("chi") > threshold)


def degrees(edges: DataFrame) -> DataFrame:
    """(topic, degree) of the topics that have an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("degree"))


def statistics(rows: DataFrame, col: str) -> DataFrame:
    """(n, mean, stdev, max, min), with the deviation of a population."""
    return rows.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("stdev"), F.max(col).alias("max"), F.min(col).alias("min"))


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "topic") -> DataFrame:
    """(vertex, component): the least vertex that each is connected to; lone vertices are their own.

    Labels spread to neighbours and then jump to the label of their label, so that rounds grow with the
    logarithm of the longest path. Every round is cut by a checkpoint.
    """
    both = cut_lineage(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    labels = cut_lineage(vertices.select(F.col(id_col).alias("v"), F.col(id_col).alias("l")).distinct())
    while True:
        seen = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("l").alias("least"))
        spread = labels.join(seen, F.col("v") == F.col("a"), "left").select("v", "l", F.least("l", "least").alias("near"))
        jump = spread.select(F.col("v").alias("w"), F.col("near").alias("far"))
        now = cut_lineage(spread.join(jump, F.col("near") == F.col("w"), "left").select("v", "l", F.least("near", "far").alias("m")))
        if now.where("m <> l").isEmpty():
            return now.select(F.col("v").alias(id_col), F.col("m").alias("component"))
        labels = now.select("v", F.col("m").alias("l"))


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size), the largest first, the lesser component first among equals."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


def component_count(components: DataFrame) -> DataFrame:
    """(components): how many there are."""
    return components.agg(F.count_distinct("component").alias("components"))


def centrality(vertices: DataFrame, edges: DataFrame, weight: str = "chi", rounds: int = 10, id_col: str = "topic") -> DataFrame:
    """(vertex, centrality): eigenvector centrality by power iteration, the greatest scaled to 1."""
    both = cut_lineage(edges.select("src", "dst", weight).union(edges.select("dst", "src", weight)).toDF("a", "b", "w"))
    scores = cut_lineage(vertices.select(F.col(id_col).alias("v"), F.lit(1.0).alias("x")).distinct())
    for _ in range(rounds):
        sums = both.join(scores, F.col("b") == F.col("v")).groupBy("a").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        joined = scores.join(sums, F.col("v") == F.col("a"), "left").select("v", F.coalesce("y", F.lit(0.0)).alias("y"))
        joined = cut_lineage(joined)
        scores = joined.select("v", F.try_divide(F.col("y"), joined.agg(F.max("y")).scalar()).alias("x")).fillna(0.0)
    return scores.toDF(id_col, "centrality")
