"""Ranking a corpus by cosine similarity to one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.vectors import cosine, doubles
from paperloom.operators.topics import TopicPipeline


def nearest(corpus: DataFrame, query: Column, vector_col: str, id_col: str, n: int = 10) -> DataFrame:
    """The ``n`` rows most like ``query`` with their ``similarity``, the smaller id first among equals."""
    asked = corpus.withColumn("query_vector", query)
    scored = asked.withColumn("similarity", cosine(doubles(F.col(vector_col)), F.col("query_vector"))).drop("query_vector")
    return scored.orderBy(F.desc("similarity"), id_col).limit(n)


def search(pipeline: TopicPipeline, corpus: DataFrame, query: str, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` documents of ``corpus`` (with ``topics``) closest to a text in topic space.

    ``understood`` is false if no word of the query is known: its vector is 0, and so is every similarity.
    """
    spark = corpus.sparkSession
    asked = pipeline.infer(spark.createDataFrame([(0, query)], "id int, text string"))
    vector = asked.select("topics").scalar()
    found = nearest(corpus, vector, "topics", id_col, n)
    return found.withColumn("query_vector", vector).withColumn("understood", F.exists("query_vector", lambda v: v > 0)).drop("query_vector")
