"""Term counts, document frequencies, IDF and TF-IDF: as relations, and as Spark ML stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Terms of the most documents that are joined by a broadcast.
OFTEN = 20_000


def term_counts(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_col, F.explode(words_col).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def row_counts(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """(id, term, tf) of each row: :func:`term_counts` without its shuffle, where no id is repeated."""
    names = [id_col, "term", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.columns
            coded = words.flatten().dictionary_encode("encode")
            row = np.repeat(np.arange(len(ids)), words.value_lengths().fill_null(0).to_numpy())
            cells, tf = np.unique(row * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(cells, max(1, len(coded.dictionary)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(tf)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(words_col).alias("words")).mapInArrow(run, f"id {kind}, term string, tf long".replace("id ", f"`{id_col}` ", 1))


def counts(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """:func:`term_counts`, by :func:`row_counts` if no id is repeated."""
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return row_counts(docs, id_col, words_col) if repeated.isEmpty() else term_counts(docs, id_col, words_col)


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def inverse_frequencies(frequencies: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, cf, idf) with idf = ln((N + 1) / (df + 1)); N counts all documents."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    return frequencies.withColumn("idf", F.log((total + 1) / (F.col("df") + 1)))


def tfidf(counts: DataFrame, inverse: DataFrame) -> DataFrame:
    """(id, term, tf, tfidf); both tables are read twice.

    The ``OFTEN`` terms of the most documents, which most counts are of, are joined where these lie; only counts of other
    terms are shuffled, so that no partition gets the rows of a frequent term.
    """
    often = inverse.orderBy(F.desc("df"), "term").limit(OFTEN).select("term", F.col("idf").alias("often_idf"))
    seen = counts.join(F.broadcast(often), "term", "left")
    near = seen.where("often_idf is not null").withColumnRenamed("often_idf", "idf")
    far = seen.where("often_idf is null").drop("often_idf").join(inverse.select("term", "idf"), "term")
    return near.unionByName(far).withColumn("tfidf", F.col("tf") * F.col("idf"))


def top_terms(weighted: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` terms of greatest weight of each document, by term among equals."""
    order = Window.partitionBy(id_col).orderBy(F.desc("tfidf"), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def occurrences(docs: DataFrame, words_col: str = "words") -> DataFrame:
    """(term, cf): occurrences of each term, counted where they lie and then by term."""
    return docs.select(F.explode(words_col).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def vocabulary(frequencies: DataFrame, size: int = 262_144, least_docs: int = 1) -> list[str]:
    """At most ``size`` terms in a total order, by occurrences and then by name, so that indices never vary.

    ``df`` isn't needed if one document is enough.
    """
    kept = (frequencies.where(F.col("df") >= least_docs) if least_docs > 1 else frequencies).orderBy(F.desc("cf"), "term").limit(size)
    return [r["term"] for r in kept.select("term").collect()]


def counter_of(spark: SparkSession, terms: list[str], words_col: str, output_col: str) -> CountVectorizerModel:
    """The count model of a vocabulary; ``from_vocabulary`` hands over one term a call, which takes most of a minute for 262,144."""
    text = "\n".join(terms)
    if not all(terms) or text.count("\n") != len(terms) - 1:
        return CountVectorizerModel.from_vocabulary(terms, words_col, output_col)
    array = spark.sparkContext._jvm.java.util.regex.Pattern.compile("\n").split(text)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", array)
    model.setInputCol(words_col).setOutputCol(output_col)
    return model._set(vocabSize=len(terms))


def vectorise(docs: DataFrame, terms: list[str], words_col: str = "words") -> tuple[CountVectorizerModel, IDFModel, DataFrame]:
    """The count and IDF models and the other columns of ``docs`` with ``features``, persisted; of the words only the counts are held, until then."""
    counter = counter_of(docs.sparkSession, terms, words_col, "raw_features")
    counted = counter.transform(docs).drop(words_col).persist()
    try:
        weights = IDF(inputCol="raw_features", outputCol="features").fit(counted)
        made = weights.transform(counted).drop("raw_features").persist()
        made.count()
    finally:
        counted.unpersist()
    return counter, weights, made
