"""The named queries over the tables of a folder, and their SQL twins.

There are no topic distributions among the tables; two stand-ins take their place. Memberships: a document's
words of three or more letters among the 45 with the highest document frequency. Distributions: squared components of
an embedding over their sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import html, text, vectors
from paperloom.operators import blocks, clustered, communities, explore, features, graph, layout, lemmas, similarity, topics
from paperloom.session import cut_lineage, discard, kept, shared_path
from paperloom.sources import readers, sinks

THRESHOLD, CHI, TIGHT_CHI, TOPICS = 0.045, 19.5, 300.0, 45
LABELS = [(0, "Text Mining"), (1, "Clustering"), (2, "Graph"), (3, "Deep Learning"), (4, "information retrieval")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents")


def _worded(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.clean_tokens(F.col("text")).alias("words"))


def _counts(spark, sf_dir):
    return features.counts(_worded(spark, sf_dir))


def _frequencies(spark, sf_dir):
    return features.document_frequencies(_counts(spark, sf_dir))


def _memberships(spark, sf_dir):
    """(doc_id, topics): the stand-in memberships, as numbers of the TOPICS most frequent terms, which are found first."""
    words = F.array_distinct(F.filter(text.regex_tokens(F.col("text")), lambda w: F.length(w) > 2))
    docs = kept(_documents(spark, sf_dir).select("doc_id", words.alias("words")))  # read for the terms and for the memberships
    held = docs.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = [r["term"] for r in held.orderBy(F.desc("df"), "term").limit(TOPICS).collect()]
    if not terms:
        return docs.select("doc_id", F.array().cast("array<int>").alias("topics"))
    number = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])
    own = F.array_intersect("words", F.array(*[F.lit(t) for t in terms]))
    return cut_lineage(docs.select("doc_id", F.transform(own, lambda w: number[w]).alias("topics")))


def _distributions(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vectors.simplex(F.col("embedding")).alias("topics"))


def tokenize_regex(spark, sf_dir):
    words = text.regex_tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ").cast("binary")).alias("tokens_md5"))


def tokens_letters_filter(spark, sf_dir):
    words = text.letter_tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ").cast("binary")).alias("tokens_md5"))


def stopwords_removed(spark, sf_dir):
    return _worded(spark, sf_dir).select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.md5(F.array_join("words", " ").cast("binary")).alias("tokens_md5"))


def lemmas_by_rules(spark, sf_dir):
    words = text.lemmatize(text.regex_tokens(F.col("text")), "rules")
    return _documents(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ").cast("binary")).alias("lemmas_md5"))


def term_doc_frequency(spark, sf_dir):
    return _frequencies(spark, sf_dir)


def inverse_doc_frequency(spark, sf_dir):
    inverse = features.inverse_frequencies(_frequencies(spark, sf_dir), _documents(spark, sf_dir))
    return inverse.select("term", F.round("idf", 6).alias("idf"))


def tfidf_top_terms(spark, sf_dir):
    counts = kept(_counts(spark, sf_dir))  # read for the frequencies and for the weights
    inverse = kept(features.inverse_frequencies(features.document_frequencies(counts), _documents(spark, sf_dir)))
    rounded = features.tfidf(counts, inverse).withColumn("tfidf", F.round("tfidf", 6))
    return features.top_terms(rounded, 5).select("doc_id", F.col("rank").cast("long").alias("rank"), "term", "tf", "tfidf")


def cosine_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").select(vectors.doubles(F.col("embedding"))).scalar()
    return similarity.nearest(rows, query, "embedding", "vec_id", 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


def major_topics(spark, sf_dir):
    rows = _distributions(spark, sf_dir).select("doc_id", F.explode(graph.major_topics(F.col("topics"), THRESHOLD)).alias("topic"))
    return rows.select("doc_id", F.col("topic").cast("long").alias("topic"))


def topic_doc_counts(spark, sf_dir):
    return graph.topic_counts(_memberships(spark, sf_dir)).select(F.col("topic").cast("long").alias("topic"), "docs")


def topic_pair_counts(spark, sf_dir):
    return graph.pair_counts(_memberships(spark, sf_dir)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cnt")


def _edges(spark, sf_dir):
    return graph.chi_square_edges(_memberships(spark, sf_dir))


def chi_square_edges(spark, sf_dir):
    return _edges(spark, sf_dir).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cnt", F.round("chi", 4).alias("chi"))


def interesting_edges(spark, sf_dir):
    return graph.interesting(_edges(spark, sf_dir), CHI).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("chi", 4).alias("chi"))


def degree(spark, sf_dir):
    kept = graph.degrees(graph.interesting(_edges(spark, sf_dir), TIGHT_CHI))
    return kept.select(F.col("topic").cast("long").alias("topic"), "degree")


def degree_stats(spark, sf_dir):
    found = graph.statistics(graph.degrees(graph.interesting(_edges(spark, sf_dir), CHI)), "degree")
    return found.select("n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "max", "min")


def _components(spark, sf_dir):
    rows = _memberships(spark, sf_dir)
    return graph.connected_components(graph.topic_counts(rows), graph.interesting(graph.chi_square_edges(rows), TIGHT_CHI))


def connected_components(spark, sf_dir):
    return _components(spark, sf_dir).select(F.col("topic").cast("long").alias("topic"), F.col("component").cast("long").alias("component"))


def component_count(spark, sf_dir):
    return graph.component_count(_components(spark, sf_dir))


def component_sizes(spark, sf_dir):
    return graph.component_sizes(_components(spark, sf_dir)).select(F.col("component").cast("long").alias("component"), "size")


def eigenvector_centrality(spark, sf_dir):
    rows = _memberships(spark, sf_dir)
    found = graph.centrality(graph.topic_counts(rows), graph.interesting(graph.chi_square_edges(rows), CHI))
    return found.select(F.col("topic").cast("long").alias("topic"), F.round("centrality", 6).alias("centrality"))


def graph_table(spark, sf_dir):
    found = sinks.graph_table(graph.interesting(_edges(spark, sf_dir), CHI).withColumn("chi", F.round("chi", 4)), "chi")
    return found.select(F.col("Source").cast("long").alias("Source"), F.col("Target").cast("long").alias("Target"), "Weight", "Type")


def corpus_topic_share(spark, sf_dir):
    found = explore.corpus_share(_distributions(spark, sf_dir))
    return found.select(F.col("topic").cast("long").alias("topic"), F.round("total", 6).alias("total"), F.round("percent", 6).alias("percent"))


def topic_weight_percentiles(spark, sf_dir):
    found = explore.weight_percentiles(_distributions(spark, sf_dir))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def topic_weight_histogram(spark, sf_dir):
    found = explore.weight_histogram(_distributions(spark, sf_dir))
    return found.select("bin", "n", F.round("density", 4).alias("density"))


def browse_topic_top10(spark, sf_dir):
    found = explore.documents_of_topic(_distributions(spark, sf_dir), 3)
    return found.select(F.col("number").cast("long").alias("number"), "doc_id", F.round("percent", 6).alias("percent"))


def doc_top5_topics(spark, sf_dir):
    found = explore.topics_of_documents(_distributions(spark, sf_dir))
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("topic").cast("long").alias("topic"), F.round("weight", 9).alias("weight"))


def weight_text_roundtrip(spark, sf_dir):
    path = shared_path(spark)
    sinks.write_values(explore.weights(_distributions(spark, sf_dir)), "weight", path)
    found = readers.numbers(spark, path).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("total", "least", "most")])


def _labels(spark):
    """The label rows, by way of a CSV file."""
    path = shared_path(spark)
    spark.createDataFrame([(i, label, None) for i, label in LABELS], readers.LABELS).coalesce(1).write.csv(path, header=True)
    return readers.labels(spark, path)


def topic_label_lookup(spark, sf_dir):
    found = explore.labelled(explore.corpus_share(_distributions(spark, sf_dir)), _labels(spark)).where("label is not null")
    return found.select(F.col("topic").cast("long").alias("topic"), "label", F.round("percent", 6).alias("percent"))


def topic_share_by_label(spark, sf_dir):
    found = explore.share_by_label(_distributions(spark, sf_dir), _labels(spark))
    number = F.row_number().over(Window.orderBy("label", "topic"))  # a row a label
    return found.select(number.cast("long").alias("number"), "label", F.col("topic").cast("long").alias("topic"), F.round("percent", 6).alias("percent"))


def label_index(spark, sf_dir):
    return explore.label_index(_labels(spark)).select(F.col("number").cast("long").alias("number"), F.col("Id").cast("long").alias("Id"), "Label")


def document_key_hash(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.document_key(html.title(F.col("html"))).alias("key"))


def abstract_between_markers(spark, sf_dir):
    page = F.concat(F.lit("Title\n Abstract \n"), F.col("text"), F.when(F.col("lang") != "de", F.lit("\n[abs] end")).otherwise(F.lit(" end")))
    found = _documents(spark, sf_dir).select("doc_id", text.between_markers(page).alias("abstract"))
    return found.select("doc_id", F.coalesce(F.length("abstract").cast("long"), F.lit(-1)).alias("n_chars"), F.md5(F.col("abstract").cast("binary")).alias("abstract_md5"))


def pdf_text_join(spark, sf_dir):
    kinds = F.array(F.lit("LTTextBox"), F.lit("LTFigure"), F.lit("LTTextLine"))
    objects = F.transform(F.split("text", "[.]"), lambda t, i: F.struct(F.element_at(kinds, (i % 3 + 1).cast("int")).alias("kind"), F.concat(t, F.lit("\n")).alias("text")))
    found = _documents(spark, sf_dir).select("doc_id", text.text_of_layout(objects).alias("found"))
    return found.select("doc_id", F.length("found").cast("long").alias("n_chars"), F.md5(F.col("found").cast("binary")).alias("text_md5"))


def page_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def page_links(spark, sf_dir):
    found = F.posexplode(html.hrefs(F.col("html"))).alias("place", "href")
    return _table(spark, sf_dir, "pages").select("page_id", found).select("page_id", F.col("place").cast("long").alias("place"), "href")


def page_link_absolute(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "url", F.explode(html.hrefs(F.col("html"))).alias("href")).where("href like '/%'")
    return rows.select("page_id", html.rooted(F.col("url"), F.col("href")).alias("link")).distinct()


def page_headings(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.try_element_at(html.select(F.col("html"), "h1"), F.lit(1)).alias("heading"))


def page_all_text(spark, sf_dir):
    found = _table(spark, sf_dir, "pages").select("page_id", html.all_text(F.col("html")).alias("found"))
    return found.select("page_id", F.length("found").cast("long").alias("n_chars"), F.md5(F.col("found").cast("binary")).alias("text_md5"))


def upsert_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "source")
    labels = _table(spark, sf_dir, "labels")
    fresh = labels.select((F.col("doc_id") + 1).alias("doc_id"), F.lit("xx").alias("lang"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("source"))
    path = shared_path(spark)
    sinks.upsert_parts(path, docs, "doc_id")
    sinks.upsert_parts(path, fresh, "doc_id")
    return spark.read.parquet(path).drop("key_part")


def edge_text_roundtrip(spark, sf_dir):
    path = shared_path(spark)
    sinks.write_edges(graph.pair_counts(_memberships(spark, sf_dir)), path, "cnt")
    return readers.edges(spark, path)


def seed_urls(spark, sf_dir):
    found = [readers.seeds_of(spark, source).select(F.lit(source).alias("source"), "url") for source in readers.SEEDS]
    return reduce(DataFrame.unionByName, found)


def _pipeline(spark, sf_dir, k=5, scores=False):
    """The documents with counts in place of texts, written, for training and inference alike; the pipeline and its scores."""
    words = _documents(spark, sf_dir).select("doc_id", "source", text.clean_tokens(F.col("text")).alias("words"))
    counter, weights, docs = topics.counted(words)
    return docs, topics.choose(counter, weights, docs, (k,), scores=scores)


def lda_doc_topics(spark, sf_dir):
    docs, (pipeline, _) = _pipeline(spark, sf_dir)
    return pipeline.infer(docs).select("doc_id", "topics")


def lda_topic_words(spark, sf_dir):
    docs, (pipeline, _) = _pipeline(spark, sf_dir)
    discard(docs)
    return topics.word_weights(topics.topic_words(pipeline))


def lda_model_selection(spark, sf_dir):
    _, scores = topics.train(_documents(spark, sf_dir), (2, 5))
    return spark.createDataFrame(scores, "k int, log_likelihood double, log_perplexity double")


def lda_search(spark, sf_dir):
    """The documents nearest to the first text of ``benchmark``."""
    docs, (pipeline, _) = _pipeline(spark, sf_dir)
    query = _table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    found = similarity.search(pipeline, pipeline.infer(docs), query, 10)
    return found.select("doc_id", "source", "similarity", "understood")


def layout_texts(spark, sf_dir):
    """Documents set as pages of a heading and two columns, a box a word, and read back from the boxes alone."""
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(words).alias("n", "text"))
    page, at = F.floor(F.col("n") / 606), F.col("n") % 606  # six words a line, a line of heading, fifty lines a column
    line, column = F.floor((at - 6) % 300 / 6), F.floor((at - 6) / 300)
    x = F.when(at < 6, 350).otherwise(1000 * column) + 120 * (at % 6)
    y = F.when(at < 6, 800).otherwise(740 - 14 * line - 4 * column)
    glyphs = rows.select("doc_id", page.alias("page"), x.alias("x0"), (y - 10).alias("y0"), (x + 6 * F.least(F.length("text"), F.lit(18))).alias("x1"), y.alias("y1"), "text")
    found = layout.texts(glyphs, column_gap=150.0)
    return found.select("doc_id", "page", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def cosine_topk_clustered(spark, sf_dir):
    """``cosine_topk`` from a clustered table, of which only clusters that can hold a hit are read."""
    path, rows = shared_path(spark), _table(spark, sf_dir, "embeddings")
    clustered.build(rows, path, "vec_id", "embedding")
    query = rows.where("vec_id = 0").select(vectors.doubles(F.col("embedding")).alias("v")).first()
    found = clustered.Clusters(spark, path, "vec_id", "embedding").nearest(query["v"], 10) if query else similarity.nearest(rows, F.array(), "embedding", "vec_id", 0)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def browse_topic_clustered(spark, sf_dir):
    """``browse_topic_top10`` from a clustered table."""
    path = shared_path(spark)
    clustered.build(_distributions(spark, sf_dir), path)
    found = clustered.Clusters(spark, path).documents_of_topic(3)
    return found.select(F.col("number").cast("long").alias("number"), "doc_id", F.round("percent", 6).alias("percent"))


def learned_lemmas(spark, sf_dir):
    """Every term of each language with its learned lemma."""
    docs = _documents(spark, sf_dir).select("lang", text.regex_tokens(F.col("text")).alias("words"))
    terms = kept(lemmas.term_table(docs, lang_col="lang"))  # read to learn from and for the result
    return lemmas.applied(terms, lemmas.learn(terms)).select("lang", "term", "lemma", "n")


def topic_communities(spark, sf_dir):
    rows = _memberships(spark, sf_dir)
    edges = cut_lineage(graph.interesting(graph.chi_square_edges(rows), CHI))  # read for the communities and for their modularity
    found = communities.community_table(graph.topic_counts(rows), edges)
    return found.select(F.col("topic").cast("long").alias("topic"), F.col("community").cast("long").alias("community"), "size", F.round("modularity", 9).alias("modularity"))


def lda_blocked_topics(spark, sf_dir):
    """45 topics over all documents and the whole vocabulary, fitted in blocks."""
    docs, _ = blocks.fit(blocks.weighted_cells(_worded(spark, sf_dir)), TOPICS, rounds=10)
    return docs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lda_search(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_regex, tokens_letters_filter, stopwords_removed, lemmas_by_rules, term_doc_frequency, inverse_doc_frequency,
        tfidf_top_terms, cosine_topk, major_topics, topic_doc_counts, topic_pair_counts, chi_square_edges, interesting_edges,
        degree, degree_stats, connected_components, component_count, component_sizes, eigenvector_centrality, graph_table, corpus_topic_share,
        topic_weight_percentiles, topic_weight_histogram, weight_text_roundtrip, browse_topic_top10, doc_top5_topics, topic_label_lookup, topic_share_by_label, label_index,
        document_key_hash, abstract_between_markers, pdf_text_join, page_title, page_links, page_link_absolute, page_headings, page_all_text,
        upsert_documents, edge_text_roundtrip, seed_urls, lda_doc_topics, lda_topic_words, lda_model_selection, lda_search,
        layout_texts, cosine_topk_clustered, browse_topic_clustered, learned_lemmas, topic_communities, lda_blocked_topics,
    )
}

_REGEX = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) >= 1)"
_LEMMA = (
    "CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' "
    "WHEN ends_with(w, 'ing') AND substr(w, -4, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(w, length(w) - 3) "
    "WHEN ends_with(w, 'ed') AND substr(w, -3, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(w, length(w) - 2) "
    "WHEN ends_with(w, 's') AND substr(w, -2, 1) NOT IN ('s', 'u') THEN left(w, length(w) - 1) ELSE w END"
)
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in [*text.ENGLISH, *text.DOMAIN])
_CLEAN = f"list_filter({_REGEX}, lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_WORDS = f"words AS (SELECT doc_id, {_CLEAN} AS w FROM documents)"
_COUNTS = f"{_WORDS}, counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL)"
_DF = f"{_COUNTS}, df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM counts GROUP BY term)"
_HELD = (
    f"held AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_REGEX}) AS term FROM documents) WHERE length(term) > 2), "
    "numbered AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS topic FROM (SELECT term, count(*) AS n FROM held GROUP BY term) "
    f"QUALIFY topic < {TOPICS}), members AS (SELECT doc_id, topic FROM held JOIN numbered USING (term))"
)
_PAIRS = f"{_HELD}, pairs AS (SELECT a.topic AS src, b.topic AS dst, count(*) AS cnt FROM members a JOIN members b ON a.doc_id = b.doc_id AND a.topic < b.topic GROUP BY ALL)"
_EDGES = (
    f"{_PAIRS}, totals AS (SELECT topic, count(*)::DOUBLE AS docs FROM members GROUP BY topic), "
    "joined AS (SELECT src, dst, cnt, cnt::DOUBLE AS yy, s.docs AS yb, d.docs AS ya, (SELECT count(*) FROM documents)::DOUBLE AS t "
    "FROM pairs JOIN totals s ON s.topic = src JOIN totals d ON d.topic = dst), "
    "edges AS (SELECT src, dst, cnt, t * power(yy * (t - (yb - yy) - (ya - yy) - yy) - (ya - yy) * (yb - yy) - t / 2, 2) / nullif(ya * (t - ya) * yb * (t - yb), 0) AS chi FROM joined)"
)
_SIMPLEX = (
    "squares AS (SELECT vec_id AS doc_id, i - 1 AS topic, embedding[i]::DOUBLE * embedding[i]::DOUBLE AS sq "
    "FROM embeddings, generate_series(1, 64) AS s(i)), "
    "weights AS (SELECT doc_id, topic, sq / sum(sq ORDER BY topic) OVER (PARTITION BY doc_id) AS weight FROM squares)"
).replace("sum(sq ORDER BY topic) OVER (PARTITION BY doc_id)", "sum(sq) OVER (PARTITION BY doc_id)")
_REACH = (
    f"{_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE chi > {TIGHT_CHI} UNION SELECT dst, src FROM edges WHERE chi > {TIGHT_CHI}), "
    "reach AS (SELECT DISTINCT topic AS v, topic AS l FROM members UNION SELECT b, l FROM reach JOIN both_ways ON a = v), "
    "comps AS (SELECT v AS topic, min(l) AS component FROM reach GROUP BY v)"
)
_CENTRAL = (
    f"both_ways AS MATERIALIZED (SELECT src AS a, dst AS b, chi AS w FROM edges WHERE chi > {CHI} UNION ALL SELECT dst, src, chi FROM edges WHERE chi > {CHI}), "
    "x0 AS MATERIALIZED (SELECT DISTINCT topic, 1::DOUBLE AS x FROM members)"
)
for _i in range(10):
    _CENTRAL += (
        f", y{_i} AS MATERIALIZED (SELECT v.topic, coalesce(sum(w * n.x), 0) AS y FROM x{_i} v LEFT JOIN both_ways ON a = v.topic LEFT JOIN x{_i} n ON n.topic = b GROUP BY v.topic), "
        f"x{_i + 1} AS MATERIALIZED (SELECT topic, coalesce(y / nullif((SELECT max(y) FROM y{_i}), 0), 0) AS x FROM y{_i})"
    )
_DECODED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g')"
_TITLE = _DECODED.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
_FOLD = "(('0x' || substr(h, {i}, 8))::BIGINT)"
_KEY = "0"
for _i in range(1, 65, 8):
    _KEY = f"(({_KEY}) * {4294967296 % 100_000_000} + {_FOLD.format(i=_i)}) % 100000000"

_LEARNED = f"""
terms AS (
  SELECT coalesce(lang, '') AS lang, term, count(*) AS n FROM (SELECT lang, unnest({_REGEX}) AS term FROM documents) GROUP BY ALL),
cut AS (
  SELECT lang, term, left(term, length(term) - k) AS stem, right(term, k) AS ending
  FROM (SELECT lang, term, unnest(generate_series(0, least({lemmas.LONGEST}, length(term) - {lemmas.STEM}))) AS k FROM terms WHERE length(term) >= {lemmas.STEM})),
looked_at AS (
  SELECT lang, ending, count(*) AS shown FROM cut GROUP BY lang, ending
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) * (1 + length(ending)) DESC, ending) <= {lemmas.ENDINGS}),
splits AS MATERIALIZED (
  SELECT lang, ending, term, stem, shown FROM cut JOIN looked_at USING (lang, ending)),
sizes AS (
  SELECT lang, ceil(log2(count(*)))::BIGINT AS bits FROM terms GROUP BY lang),
stems AS (
  SELECT lang, count(DISTINCT stem) AS n_stems FROM splits GROUP BY lang),
rules AS MATERIALIZED (
  SELECT a.lang, a.ending, b.ending AS base, count(*) AS n, sum({lemmas.LETTER} * length(a.stem) - bits) - {lemmas.LETTER} * (length(a.ending) + length(b.ending) + 2) AS gain
  FROM splits a JOIN splits b ON a.lang = b.lang AND a.stem = b.stem JOIN sizes s ON a.lang = s.lang JOIN stems t ON a.lang = t.lang
  WHERE (length(a.ending) > length(b.ending) OR length(a.ending) = length(b.ending) AND a.ending > b.ending) AND (b.ending = '' OR left(a.ending, 1) <> left(b.ending, 1))
  GROUP BY a.lang, a.ending, b.ending
  HAVING gain > 0 AND n >= {lemmas.LEAST} AND n * any_value(n_stems) >= any_value(a.shown) * any_value(b.shown)),
next AS MATERIALIZED (
  SELECT s.lang, s.term, stem || base AS lemma FROM splits s JOIN rules r ON s.lang = r.lang AND s.ending = r.ending JOIN terms t ON s.lang = t.lang AND t.term = stem || base
  QUALIFY row_number() OVER (PARTITION BY s.lang, s.term ORDER BY gain DESC, base) = 1),
chains AS (
  SELECT lang, term, lemma, 1 AS hops FROM next
  UNION ALL SELECT c.lang, c.term, n.lemma, hops + 1 FROM chains c JOIN next n ON c.lang = n.lang AND c.lemma = n.term)
"""

ORACLES = {
    "learned_lemmas": f"""
WITH RECURSIVE {_LEARNED}
SELECT t.lang, t.term, coalesce(c.lemma, t.term) AS lemma, n FROM terms t
LEFT JOIN (SELECT lang, term, last(lemma ORDER BY hops) AS lemma FROM chains GROUP BY lang, term) c ON t.lang = c.lang AND t.term = c.term
""",
    "tokenize_regex": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {_REGEX} AS w FROM documents)",
    "tokens_letters_filter": (
        "SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS tokens_md5 FROM (SELECT doc_id, "
        "list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\\p{L}]+'), lambda w: length(w) > 2), lambda w: lower(w)) AS w FROM documents)"
    ),
    "stopwords_removed": f"WITH {_WORDS} SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS tokens_md5 FROM words",
    "lemmas_by_rules": f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(coalesce(array_to_string(w, ' '), '')) AS lemmas_md5 FROM (SELECT doc_id, list_transform({_REGEX}, lambda w: {_LEMMA}) AS w FROM documents)",
    "term_doc_frequency": f"WITH {_DF} SELECT term, df, cf FROM df",
    "inverse_doc_frequency": f"WITH {_DF} SELECT term, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS idf FROM df",
    "tfidf_top_terms": (
        f"WITH {_DF}, weighed AS (SELECT doc_id, term, tf, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS tfidf FROM counts JOIN df USING (term)) "
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) AS rank, term, tf, tfidf FROM weighed QUALIFY rank <= 5"
    ),
    "cosine_topk": (
        "SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s "
        "FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10"
    ),
    "major_topics": f"WITH {_SIMPLEX} SELECT doc_id, topic::BIGINT AS topic FROM weights WHERE weight >= {THRESHOLD}",
    "topic_doc_counts": f"WITH {_HELD} SELECT topic, count(*) AS docs FROM members GROUP BY topic",
    "topic_pair_counts": f"WITH {_PAIRS} SELECT src, dst, cnt FROM pairs",
    "chi_square_edges": f"WITH {_EDGES} SELECT src, dst, cnt, round(chi, 4) AS chi FROM edges",
    "interesting_edges": f"WITH {_EDGES} SELECT src, dst, round(chi, 4) AS chi FROM edges WHERE chi > {CHI}",
    "degree": f"WITH {_EDGES} SELECT topic, count(*) AS degree FROM (SELECT unnest([src, dst]) AS topic FROM edges WHERE chi > {TIGHT_CHI}) GROUP BY topic",
    "degree_stats": (
        f"WITH {_EDGES}, degrees AS (SELECT topic, count(*) AS degree FROM (SELECT unnest([src, dst]) AS topic FROM edges WHERE chi > {CHI}) GROUP BY topic) "
        "SELECT count(degree) AS n, round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS stdev, max(degree) AS max, min(degree) AS min FROM degrees"
    ),
    "connected_components": f"WITH RECURSIVE {_REACH} SELECT topic, component FROM comps",
    "component_sizes": f"WITH RECURSIVE {_REACH} SELECT component, count(*) AS size FROM comps GROUP BY component",
    "component_count": f"WITH RECURSIVE {_REACH} SELECT count(DISTINCT component) AS components FROM comps",
    "eigenvector_centrality": f"WITH {_EDGES}, {_CENTRAL} SELECT topic, round(x, 6) AS centrality FROM x10",
    "graph_table": f"WITH {_EDGES} SELECT src AS \"Source\", dst AS \"Target\", round(chi, 4) AS \"Weight\", 'Undirected' AS \"Type\" FROM edges WHERE chi > {CHI}",
    "corpus_topic_share": (
        f"WITH {_SIMPLEX} SELECT topic::BIGINT AS topic, round(sum(weight), 6) AS total, round(sum(weight) / (SELECT count(*) FROM embeddings) * 100, 6) AS percent FROM weights GROUP BY topic"
    ),
    "topic_weight_percentiles": (
        f"WITH {_SIMPLEX} SELECT round(quantile_cont(weight, 0.8), 9) AS p80, round(quantile_cont(weight, 0.9), 9) AS p90, round(quantile_cont(weight, 0.5), 9) AS p50, "
        "round(min(weight), 9) AS least, round(max(weight), 9) AS most FROM weights"
    ),
    "topic_weight_histogram": (
        f"WITH {_SIMPLEX}, ends AS (SELECT min(weight) AS a, max(weight) AS b, count(*) AS c FROM weights) "
        "SELECT least(100, floor((weight - a) / (b - a) * 100)::BIGINT + 1) AS bin, count(*) AS n, round(count(*) / (any_value(c) * ((any_value(b) - any_value(a)) / 100)), 4) AS density "
        "FROM weights, ends GROUP BY bin"
    ),
    "browse_topic_top10": (
        f"WITH {_SIMPLEX} SELECT row_number() OVER (ORDER BY weight DESC, doc_id) AS number, doc_id, round(weight * 100, 6) AS percent FROM weights WHERE topic = 3 QUALIFY number <= 10"
    ),
    "doc_top5_topics": (
        f"WITH {_SIMPLEX} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) AS rank, topic::BIGINT AS topic, round(weight, 9) AS weight FROM weights QUALIFY rank <= 5"
    ),
    "topic_label_lookup": (
        f"WITH {_SIMPLEX}, labels_(topic, label) AS (VALUES {', '.join(str(x) for x in LABELS)}) SELECT topic::BIGINT AS topic, label, "
        "round(sum(weight) / (SELECT count(*) FROM embeddings) * 100, 6) AS percent FROM weights JOIN labels_ USING (topic) GROUP BY ALL"
    ),
    "topic_share_by_label": (
        f"WITH {_SIMPLEX}, labels_(topic, label) AS (VALUES {', '.join(str(x) for x in LABELS)}) SELECT row_number() OVER (ORDER BY label, topic) AS number, label, topic::BIGINT AS topic, "
        "round(percent, 6) AS percent FROM (SELECT topic, label, sum(weight) / (SELECT count(*) FROM embeddings) * 100 AS percent FROM weights JOIN labels_ USING (topic) GROUP BY ALL)"
    ),
    "label_index": f"SELECT row_number() OVER (ORDER BY label, id) AS number, id::BIGINT AS \"Id\", label AS \"Label\" FROM (VALUES {', '.join(str(x) for x in LABELS)}) AS v(id, label)",
    "document_key_hash": f"SELECT page_id, ({_KEY})::BIGINT AS key FROM (SELECT page_id, sha256({_TITLE}) AS h FROM pages)",
    "abstract_between_markers": (
        "SELECT doc_id, coalesce(length(t), -1)::BIGINT AS n_chars, md5(t) AS abstract_md5 FROM (SELECT doc_id, CASE WHEN p LIKE '%[abs]%' THEN trim(replace(p[:strpos(p, '[abs]') - 1], chr(10), ' ')) END AS t "
        "FROM (SELECT doc_id, ' ' || chr(10) || text || CASE WHEN lang <> 'de' THEN chr(10) || '[abs] end' ELSE ' end' END AS p FROM documents))"
    ),
    "pdf_text_join": (
        "SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, replace(chr(10) || array_to_string(list_transform(list_filter(generate_series(1, len(s)), "
        "lambda i: (i - 1) % 3 <> 1), lambda i: s[i] || chr(10)), chr(10)), chr(10) || chr(10), chr(10)) AS t FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents))"
    ),
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_links": (
        "SELECT page_id, unnest(generate_series(0, len(h) - 1)) AS place, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages) WHERE len(h) > 0"
    ),
    "page_link_absolute": (
        "SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]+') || href AS link FROM "
        "(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE href LIKE '/%'"
    ),
    "page_headings": f"SELECT page_id, {_DECODED.format("regexp_extract(html, '<h1>([^<]*)', 1)")} AS heading FROM pages",
    "page_all_text": (
        # A tag inside a script is text; chr(1) stands for its bracket meanwhile.
        "WITH marked AS (SELECT page_id, regexp_replace(html, '(<script>[^<]*)<(/?[a-z]+>[^<]*</script>)', '\\1' || chr(1) || '\\2', 'g') AS h FROM pages), "
        "bare AS (SELECT page_id, regexp_replace(regexp_replace(h, '<!--.*?-->', '', 'gs'), '<[^>\"]*(\"[^\"]*\"[^>\"]*)*>', '', 'g') AS h FROM marked) "
        "SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, "
        + _DECODED.format("replace(replace(replace(h, chr(1), '<'), '&copy;', chr(169)), '&middot;', chr(183))") + " AS t FROM bare)"
    ),
    "upsert_documents": (
        "WITH fresh AS (SELECT doc_id + 1 AS doc_id, 'xx' AS lang, 'quality ' || quality AS source FROM labels) "
        "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT * FROM fresh"
    ),
    "weight_text_roundtrip": f"WITH {_SIMPLEX} SELECT count(*) AS n, round(sum(weight), 6) AS total, round(min(weight), 6) AS least, round(max(weight), 6) AS most FROM weights",
    "edge_text_roundtrip": f"WITH {_PAIRS} SELECT src, dst, cnt::DOUBLE AS weight FROM pairs",
    "seed_urls": (
        "SELECT 'JMLR' AS source, 'http://www.jmlr.org/papers/v' || i || '/' AS url FROM generate_series(13, 18) AS s(i) UNION ALL VALUES "
        + ", ".join(f"('{k}', '{u}')" for k, v in readers.SEEDS.items() if isinstance(v, list) for u in v)
    ),
}
ORACLES |= {"cosine_topk_clustered": ORACLES["cosine_topk"], "browse_topic_clustered": ORACLES["browse_topic_top10"]}
ORACLES["layout_texts"] = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS n
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents)),
lines AS (
  SELECT doc_id, n // 606 AS page, n // 6 AS line, string_agg(word, ' ' ORDER BY n) AS line_text FROM words GROUP BY ALL)
SELECT doc_id, page, count(*) AS n_lines, md5(string_agg(line_text, chr(10) ORDER BY line)) AS text_md5 FROM lines GROUP BY doc_id, page
"""
