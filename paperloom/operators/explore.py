"""Aggregates that describe topics over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.vectors import largest
from paperloom.session import kept


def weights(docs: DataFrame, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """(id, topic, weight)."""
    return docs.select(id_col, F.posexplode(vector_col).alias("topic", "weight"))


def corpus_share(docs: DataFrame, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """(topic, total, percent): summed weights, and their share of all documents."""
    n = docs.agg(F.count(F.lit(1))).scalar()
    sums = weights(docs, id_col, vector_col).groupBy("topic").agg(F.sum("weight").alias("total"))
    return sums.withColumn("percent", F.try_divide(F.col("total"), n.cast("double")) * 100)


def percentiles(rows: DataFrame, col: str, at: tuple[float, ...]) -> DataFrame:
    """One row: exact percentiles of ``col`` (named p80, ...) with linear interpolation, and the extremes; nulls don't count.

    Equal values are counted first and the distinct ones ranked over a range partitioning: each partition numbers its
    own from what the ones before it hold, so no task sees more than its range.
    """
    counted = rows.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spread = kept(counted.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy("part").agg(F.sum("n").alias("held"))
    before = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    last = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.col("before") - 1
    ranked = spread.join(F.broadcast(before), "part").withColumn("last", last)  # a row a partition
    total, out = spread.agg(F.sum("n")).scalar(), []
    for p in at:
        place = (total - 1) * F.lit(float(p))
        first = F.col("last") - F.col("n") + 1
        value = lambda rank, first=first: F.max(F.when((rank >= first) & (rank <= F.col("last")), F.col("value")))
        low, high, share = value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(f"p{round(100 * p)}"))
    return ranked.agg(*out, F.min("value").alias("least"), F.max("value").alias("most"))


def weight_percentiles(docs: DataFrame, at: tuple[float, ...] = (0.8, 0.9, 0.5), id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """One row: ``percentiles`` of all weights."""
    return percentiles(weights(docs, id_col, vector_col), "weight", at)


def threshold_at(docs: DataFrame, percentile: float = 0.8, vector_col: str = "topics") -> float:
    """The weight at a percentile, to use as a membership threshold."""
    return percentiles(docs.select(F.explode(vector_col).alias("w")), "w", (percentile,)).first()[0]


def weight_histogram(docs: DataFrame, bins: int = 100, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """(bin, n, density) over equal bins from the least to the greatest weight; the last one is closed."""
    rows = weights(docs, id_col, vector_col)
    ends = rows.agg(F.struct(F.min("weight").alias("least"), F.max("weight").alias("most"), F.count("weight").alias("n"))).scalar()
    least, most, n = ends["least"], ends["most"], ends["n"]
    binned = rows.select(F.least(F.width_bucket(F.col("weight"), least, most, F.lit(bins)), F.lit(bins)).alias("bin"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("density", F.try_divide(F.col("n"), n * ((most - least) / bins)))


def numbered(rows: DataFrame, by: str, id_col: str = "doc_id") -> DataFrame:
    """A few ``rows`` with their number from 1, the greatest of ``by`` first and the smaller id first among equals."""
    return rows.withColumn("number", F.row_number().over(Window.orderBy(F.desc(by), id_col)))


def documents_of_topic(docs: DataFrame, topic: int, n: int = 10, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """The ``n`` documents of greatest weight for a topic, with their number and weight in percent."""
    weighed = docs.withColumn("percent", F.element_at(vector_col, topic + 1) * 100).orderBy(F.desc("percent"), id_col).limit(n)
    return numbered(weighed, "percent", id_col)


def topics_of_documents(docs: DataFrame, n: int = 5, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """(id, rank, topic, weight): the ``n`` greatest topics of each document."""
    rows = docs.select(id_col, F.posexplode(largest(F.col(vector_col), n)).alias("rank", "top"))
    return rows.select(id_col, (F.col("rank") + 1).alias("rank"), "top.topic", "top.weight")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with topic) joined to labels (Id, Label) on the id, not on the place."""
    return rows.join(labels.select(F.col("Id").alias("topic"), F.col("Label").alias("label")), "topic", "left")


def share_by_label(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", vector_col: str = "topics") -> DataFrame:
    """(label, topic, total, percent): the corpus share of each labelled topic, in the order of labels, as its chart shows it."""
    return labelled(corpus_share(docs, id_col, vector_col), labels).where("label is not null").orderBy("label", "topic").select("label", "topic", "total", "percent")


def with_labelled_topics(docs: DataFrame, labels: DataFrame, id_col: str, shown: tuple[str, ...], n: int = 5) -> DataFrame:
    """(id, topic, rank, weight, label, shown): the ``n`` greatest topics of each of a few numbered documents, in their order."""
    named = labelled(topics_of_documents(docs, n, id_col), labels)
    return named.join(docs.select(id_col, *shown), id_col).orderBy("number", "rank")


def label_index(labels: DataFrame) -> DataFrame:
    """(number, Id, Label): labels in code-point order, numbered from 1."""
    return labels.select(F.row_number().over(Window.orderBy("Label", "Id")).alias("number"), "Id", "Label")
