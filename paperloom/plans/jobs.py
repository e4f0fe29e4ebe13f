"""The jobs: train, search, relationship graph, export. Each writes below one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text
from paperloom.operators import blocks, explore, features, graph, similarity, topics
from paperloom.session import cut_lineage, kept
from paperloom.sources import sinks


def train(docs: DataFrame, path: str, candidates: tuple[int, ...] = (2,), text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Models, topic words, topic distributions and a log below ``path``.

    The log is a frame (k, log_likelihood, log_perplexity, chosen, vocabulary_size, document_concentration), the last
    one for the chosen model. Distributions keep all columns of ``docs`` but binary contents, the text included, so that
    hits can show it.
    """
    spark = docs.sparkSession
    pipeline, scores = topics.train(docs, candidates, id_col=id_col, text_col=text_col, **options)
    pipeline.save(path)
    topics.topic_words(pipeline).write.mode("overwrite").parquet(f"{path}/topicWords.parquet")
    pipeline.infer(docs.drop("content"), text_col).write.mode("overwrite").parquet(f"{path}/topicDistribution.parquet")
    chosen, size, alpha = pipeline.model.getK(), len(pipeline.counter.vocabulary), topics.concentration(pipeline)
    rows = [(k, a, b, k == chosen, size, alpha if k == chosen else None) for k, a, b in scores]
    log = spark.createDataFrame(rows, "k int, log_likelihood double, log_perplexity double, chosen boolean, vocabulary_size int, document_concentration array<double>")
    sinks.write_log(log, f"{path}/log")
    return log


def search(spark: SparkSession, path: str, query: str, n: int = 10, id_col: str = "doc_id", lemmatizer: Callable[[str], str] | None = None) -> DataFrame:
    """The ``n`` documents below ``path`` that are closest to a text."""
    corpus = spark.read.parquet(f"{path}/topicDistribution.parquet")
    return similarity.search(topics.TopicPipeline.load(spark, path, lemmatizer), corpus, query, n, id_col)


def train_blocks(docs: DataFrame, path: str, candidates: tuple[int, ...] = (2,), text_col: str = "text", id_col: str = "doc_id", at_once: int = 2, **options) -> DataFrame:
    """Like :func:`train`, over the whole vocabulary in blocks: term topics, distributions and a log (k, fold_in, chosen) below ``path``.

    Several candidates are scored by folding in: half of each document's terms infers, the other half is scored. Documents without a
    weighted term have a null distribution.
    """
    spark = docs.sparkSession
    worded = kept(docs.select(id_col, text.clean_tokens(F.col(text_col)).alias("words")))
    counts = kept(features.term_counts(worded, id_col))
    inverse = kept(features.inverse_frequencies(features.document_frequencies(counts), worded))
    cells = kept(features.tfidf(counts, inverse).select(id_col, "term", F.col("tfidf").alias("weight")))
    if len(set(candidates)) > 1:
        chosen, scores, (of_docs, of_terms) = blocks.choose(cells, cells, candidates, at_once, id_col, **options)
    else:
        chosen, scores = candidates[0], {candidates[0]: None}
        of_docs, of_terms = blocks.fit(cells, chosen, id_col=id_col, **options)
    of_terms.join(inverse.select("term", "idf"), "term").write.mode("overwrite").parquet(f"{path}/termTopics")
    docs.drop("content").join(of_docs, id_col, "left").write.mode("overwrite").parquet(f"{path}/topicDistribution.parquet")
    log = spark.createDataFrame([(k, score, k == chosen) for k, score in scores.items()], "k int, fold_in double, chosen boolean")
    sinks.write_log(log, f"{path}/log")
    return log


def search_blocks(spark: SparkSession, path: str, query: str, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` documents below ``path``, trained in blocks, that are closest to a text; none if no word of it is known."""
    terms = spark.read.parquet(f"{path}/termTopics")
    asked = spark.createDataFrame([(0, query)], f"{id_col} int, text string").select(id_col, text.clean_tokens(F.col("text")).alias("words"))
    cells = features.term_counts(asked, id_col).join(terms.select("term", "idf"), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("weight"))
    vector = blocks.infer(cells, terms.select("term", "weights"), id_col).first()
    corpus = spark.read.parquet(f"{path}/topicDistribution.parquet").where("topics is not null")
    if vector is None:
        return corpus.withColumn("similarity", F.lit(0.0)).limit(0)
    return similarity.nearest(corpus, F.array(*[F.lit(x) for x in vector["topics"]]), "topics", id_col, n)


def relationship(spark: SparkSession, path: str, out: str, threshold: float = 0.0004795, chi: float = 19.5) -> dict[str, DataFrame]:
    """Topic graphs of the distributions below ``path``, written below ``out``: all that the job reports, by name."""
    docs = spark.read.parquet(f"{path}/topicDistribution.parquet").select("topics")
    sinks.write_values(docs.select(F.explode("topics").alias("weight")), "weight", f"{out}/topicDistributionStat")
    major = docs.select(graph.major_topics(F.col("topics"), threshold).alias("topics"))
    vertices = graph.topic_counts(major)
    edges = cut_lineage(graph.chi_square_edges(major))
    kept = graph.interesting(edges, chi)
    sinks.write_edges(edges, f"{out}/topicGraph", "cnt")
    sinks.write_edges(kept, f"{out}/interestingGraph", "chi")
    sinks.write_graph(kept, f"{out}/graph", "chi")
    found = {"vertices": vertices, "edges": edges, "interesting": kept, "chi_statistics": graph.statistics(edges, "chi")}
    for name, some in (("", edges), ("interesting_", kept)):
        components = graph.connected_components(vertices, some)
        found[f"{name}degree_statistics"] = graph.statistics(graph.degrees(some), "degree")
        found[f"{name}components"] = components
        found[f"{name}component_count"] = graph.component_count(components)
        found[f"{name}component_sizes"] = graph.component_sizes(components)
    return found


def export(spark: SparkSession, path: str, out: str) -> None:
    """Appends the distributions below ``path`` to a store of documents with array columns."""
    rows = spark.read.parquet(f"{path}/topicDistribution.parquet").withColumnRenamed("topics", "topic_distribution")
    rows.write.mode("append").parquet(out)


def browse(spark: SparkSession, path: str, topic: int, labels: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The top documents of a topic, each with its five greatest topics by label."""
    docs = spark.read.parquet(f"{path}/topicDistribution.parquet")
    return explore.with_labelled_topics(explore.documents_of_topic(docs, topic, n, id_col), labels, id_col, ("number", "percent"))


def search_page(spark: SparkSession, path: str, query: str, labels: DataFrame, n: int = 10, id_col: str = "doc_id", lemmatizer: Callable[[str], str] | None = None) -> DataFrame:
    """The ``n`` hits of a search as its page shows them: number, document, similarity, and the five greatest topics by label."""
    hits = explore.numbered(search(spark, path, query, n, id_col, lemmatizer), "similarity", id_col)
    shown = tuple(c for c in hits.columns if c not in (id_col, "topics"))
    return explore.with_labelled_topics(hits, labels, id_col, shown)
