"""Topic models: fit, choose, describe, infer, save, load."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from paperloom.functions import text
from paperloom.operators import blocks, features
from paperloom.operators import lemmas as learned
from paperloom.session import CLEANED, discard, kept, settings


SETTINGS = "mode string, lemmas string, partitions int"
#: Documents a partition of the layout that models are fitted on, if the number of partitions isn't given.
DOCS_A_PARTITION = 1250
#: Partitions at most, as each sends a topics x terms matrix in every iteration.
MOST_PARTITIONS = 64


@dataclass
class TopicPipeline:
    """All that turns text into topic distributions; training and search use the same one.

    ``partitions`` is the layout that the model was fitted on. Of a lemmatiser that is a function only the fact
    that there was one is saved; it is handed over again at loading.
    """

    counter: CountVectorizerModel
    weights: IDFModel
    model: LDAModel
    mode: str = "regex"
    lemmas: str | Callable[[str], str] = "none"
    partitions: int = 1

    def words(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        return docs.withColumn("words", text.clean_tokens(F.col(text_col), self.mode, self.lemmas))

    def infer(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``topics``, an array of doubles; all 0 without a known word. Counts of :func:`counted` are taken as they are."""
        known = docs if "raw_features" in docs.columns else self.counter.transform(self.words(docs, text_col))
        made = self.model.transform(self.weights.transform(known))
        return made.select(*docs.columns, vector_to_array("topicDistribution").alias("topics"))

    def save(self, path: str) -> None:
        model = self.model.toLocal() if self.model.isDistributed() else self.model
        for stage, name in ((self.counter, "tf_model"), (self.weights, "idf_model"), (model, "lda_model")):
            stage.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        lemmas = "learned" if isinstance(self.lemmas, learned.Dictionary) else "function" if callable(self.lemmas) else self.lemmas
        if lemmas == "learned":
            self.lemmas.save(f"{path}/lemmas")
        spark.createDataFrame([(self.mode, lemmas, self.partitions)], SETTINGS).write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str, lemmatizer: Callable[[str], str] | None = None) -> TopicPipeline:
        found = spark.read.schema(SETTINGS).json(f"{path}/settings").first()
        if found["lemmas"] == "function" and lemmatizer is None:
            raise ValueError(f"the model at {path} was trained with a lemmatiser of its own; hand it over to search")
        lemmas = lemmatizer if found["lemmas"] == "function" else found["lemmas"]
        if lemmas == "learned":
            lemmas = learned.Dictionary.load(spark, f"{path}/lemmas")
        return TopicPipeline(CountVectorizerModel.load(f"{path}/tf_model"), IDFModel.load(f"{path}/idf_model"), LocalLDAModel.load(f"{path}/lda_model"), found["mode"], lemmas, found["partitions"])


def pinned(docs: DataFrame, id_col: str, partitions: int) -> DataFrame:
    """``docs`` in a fixed layout, which the optimiser's result depends on."""
    return docs.repartitionByRange(partitions, id_col).sortWithinPartitions(id_col)


def bounds(model: LDAModel, vectors: DataFrame) -> tuple[float, float]:
    """What ``logLikelihood`` and ``logPerplexity`` of a model give for sparse ``features``, in one pass over their cells.

    MLlib's methods take the exponentials of all topics x terms anew for each document, and the second turns each into a dense
    vector besides. A document's variational weights are its topics times its weight and the prior's.
    """
    local = model.toLocal() if model.isDistributed() else model
    alpha, weights = local.estimatedDocConcentration().toArray(), local.topicsMatrix().toArray()  # terms x topics
    k = len(alpha)
    eta = 1.1 if model.isDistributed() else 1 / k  # the optimizers' own, which ``train`` leaves
    logs = blocks.digamma(weights) - blocks.digamma(weights.sum(axis=0))
    whole = float(((eta - weights) * logs).sum() + (blocks.log_gamma(weights) - math.lgamma(eta)).sum() + k * math.lgamma(eta * len(weights)) - blocks.log_gamma(weights.sum(axis=0)).sum())
    prior = math.lgamma(alpha.sum()) - blocks.log_gamma(alpha).sum()
    held = vectors.sparkSession.sparkContext.broadcast(logs)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                features, topics = part.column("features"), part.column("topics")
                terms, own = (pc.struct_field(features, name) for name in ("indices", "values"))
                doc = np.repeat(np.arange(len(own)), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                weight, term = own.flatten().to_numpy(zero_copy_only=False), terms.flatten().to_numpy(zero_copy_only=False)
                sizes = np.bincount(doc, weight, len(own))
                some = np.bincount(doc, weight != 0, len(own)) > 0
                gamma = topics.flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * (sizes + alpha.sum())[:, None]
                gamma[~some] = alpha
                share = blocks.digamma(gamma) - blocks.digamma(gamma.sum(axis=1))[:, None]
                each = share[doc] + held.value[term]
                top = each.max(axis=1) if len(each) else np.zeros(0)
                cells = weight * (top + np.log(np.exp(each - top[:, None]).sum(axis=1)))
                docs = ((alpha - gamma) * share).sum(axis=1) + blocks.log_gamma(gamma).sum(axis=1) + prior - blocks.log_gamma(gamma.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([float(cells.sum() + docs[some].sum())]), pa.array([float(sizes.sum())])], ["bound", "weight"])

    given = model.transform(vectors).select("features", vector_to_array("topicDistribution").alias("topics"))
    row = given.mapInArrow(scored, "bound double, weight double").agg(F.sum("bound").alias("bound"), F.sum("weight").alias("weight")).first()
    held.destroy()
    likelihood = whole + (row["bound"] or 0.0)
    return likelihood, (-likelihood / row["weight"] if row["weight"] else math.inf)


def train(
    docs: DataFrame,
    candidates: tuple[int, ...] = (2,),
    iterations: int = 100,
    optimizer: str = "online",
    id_col: str = "doc_id",
    text_col: str = "text",
    mode: str = "regex",
    vocabulary_size: int = 262_144,
    least_docs: int = 1,
    lemmas: str | Callable[[str], str] = "none",
    partitions: int | None = None,
    held_out: DataFrame | None = None,
    seed: int = 1,
    scores: bool = True,
) -> tuple[TopicPipeline, list[tuple[int, float | None, float | None]]]:
    """The pipeline of best log-likelihood among numbers of topics, and (k, log-likelihood, log-perplexity) of each.

    A later candidate replaces the first only if it is strictly better. Scores are of ``docs``, or of
    ``held_out`` if given; with ``scores`` off, a single candidate isn't scored. The layout, which the result
    depends on, follows the number of documents alone unless ``partitions`` is given. With ``lemmas`` "learned" a
    dictionary is learned from ``docs`` and kept with the model.
    """
    if lemmas == "learned":
        plain = docs.select(text.clean_tokens(F.col(text_col), mode).alias("words"))
        lemmas = learned.Dictionary.of(learned.learn(learned.term_table(plain)))
    found = counted(docs.select(id_col, text.clean_tokens(F.col(text_col), mode, lemmas).alias("words")), vocabulary_size, least_docs, id_col)
    if held_out is not None:
        held_out = held_out.withColumn("words", text.clean_tokens(F.col(text_col), mode, lemmas))
    try:
        return choose(*found, candidates, iterations, optimizer, id_col, mode, lemmas, partitions, held_out, seed, scores)
    finally:
        discard(found[2])


def counted(words: DataFrame, vocabulary_size: int = 262_144, least_docs: int = 1, id_col: str = "doc_id") -> tuple[CountVectorizerModel, IDFModel, DataFrame]:
    """The count and IDF models of documents with ``words``, and their other columns with counts (``raw_features``), written.

    Words are made once and counts once: words are written until the counts are, which all passes after that read.
    """
    words = kept(words, **CLEANED)
    frequencies = features.occurrences(words) if least_docs <= 1 else features.document_frequencies(features.term_counts(words, id_col))
    counter = features.counter_of(words.sparkSession, features.vocabulary(frequencies, vocabulary_size, least_docs), "words", "raw_features")
    found = kept(counter.transform(words).drop("words"), **CLEANED)
    discard(words)
    return counter, IDF(inputCol="raw_features", outputCol="features").fit(found), found


def choose(
    counter: CountVectorizerModel,
    weights: IDFModel,
    docs: DataFrame,
    candidates: tuple[int, ...] = (2,),
    iterations: int = 100,
    optimizer: str = "online",
    id_col: str = "doc_id",
    mode: str = "regex",
    lemmas: str | Callable[[str], str] = "none",
    partitions: int | None = None,
    held_out: DataFrame | None = None,
    seed: int = 1,
    scores: bool = True,
) -> tuple[TopicPipeline, list[tuple[int, float | None, float | None]]]:
    """:func:`train` from what :func:`counted` gives; ``held_out`` have ``words``.

    MLlib holds the vectors it trains on as objects only if its input isn't persisted itself; from a persisted one it would take
    all of them out of their rows anew in every iteration, of which each looks at one in twenty. Its first look at the input
    would shuffle it once more if plans were adaptive.
    """
    candidates = tuple(dict.fromkeys(candidates))
    partitions = partitions or min(MOST_PARTITIONS, max(4, -(-docs.count() // DOCS_A_PARTITION)))
    made = weights.transform(pinned(docs.select(id_col, "raw_features"), id_col, partitions)).select(id_col, "features")
    scored = scores or len(candidates) > 1
    if scored:  # read for each fit and score; on disk, as memory is for the objects
        made = made.persist(StorageLevel.DISK_ONLY)
    try:
        scored_on = made if held_out is None else weights.transform(counter.transform(held_out))
        best, found = None, []
        for k in candidates:
            with settings(docs.sparkSession, **{"spark.sql.adaptive.enabled": "false"}):
                model = LDA(k=k, seed=seed, optimizer=optimizer, maxIter=iterations).fit(made.select("features"))
            likelihood, perplexity = bounds(model, scored_on) if scored else (None, None)
            found.append((k, likelihood, perplexity))
            if best is None or likelihood > best[0]:
                best = (likelihood, model)
    finally:
        if scored:
            made.unpersist()
    return TopicPipeline(counter, weights, best[1], mode, lemmas, partitions), found


def topic_words(pipeline: TopicPipeline, n: int = 30) -> DataFrame:
    """(topic, termIndices, termWeights, words): the ``n`` heaviest terms of each topic."""
    spark = SparkSession.active()
    described = pipeline.model.describeTopics(n)
    terms = pipeline.counter.vocabulary
    named = [(r["topic"], list(r["termIndices"]), list(r["termWeights"]), [terms[i] for i in r["termIndices"]]) for r in described.collect()]
    return spark.createDataFrame(named, "topic int, termIndices array<int>, termWeights array<double>, words array<string>")


def word_weights(words: DataFrame) -> DataFrame:
    """(topic, rank, term, weight): one row a word, as a word cloud needs."""
    zipped = F.arrays_zip(F.col("words").alias("term"), F.col("termWeights").alias("weight"))
    return words.select("topic", F.posexplode(zipped).alias("rank", "pair")).select("topic", "rank", "pair.term", "pair.weight")


def topic_matrix(pipeline: TopicPipeline) -> DataFrame:
    """(topic, term, weight): the whole topic-term matrix, each topic's weights over their sum."""
    terms = pipeline.counter.vocabulary
    named = SparkSession.active().createDataFrame(list(enumerate(terms)), "index int, term string")
    cells = pipeline.model.describeTopics(len(terms)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("cell"))
    return cells.select("topic", F.col("cell.termIndices").alias("index"), F.col("cell.termWeights").alias("weight")).join(named, "index").select("topic", "term", "weight")


def concentration(pipeline: TopicPipeline) -> list[float]:
    return pipeline.model.estimatedDocConcentration().toArray().tolist()
