"""Hand-computed cases of the topic analytics operators."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import html, text, vectors
from paperloom.operators import explore, features, graph, similarity, topics
from paperloom.plans import catalogue, dispatch, jobs, pages
from paperloom.session import kept
from paperloom.sources import readers, sinks
from paperloom.streaming import scoring

CAFE = "  Café Naïve über-Deep learning3models the cid 42 a I"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.regex_tokens(F.lit(CAFE))) == ["caf", "na", "ve", "ber", "deep", "learning", "models", "the", "cid", "a", "i"]
    assert one(spark, text.letter_tokens(F.lit(CAFE))) == ["café", "naïve", "über", "deep", "learning", "models", "the", "cid"]
    assert one(spark, text.regex_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.clean_tokens(F.lit("The Abstract of deep cid networks x"))) == ["deep", "networks"]


def test_lemmas(spark):
    words = F.array(*[F.lit(w) for w in ("studies", "classes", "models", "bus", "trained")])
    assert one(spark, text.lemmatize(words, "rules")) == ["study", "class", "model", "bus", "train"]
    assert one(spark, text.lemmatize(words, lambda w: w[:2])) == ["st", "cl", "mo", "bu", "tr"]
    with pytest.raises(ValueError):
        text.lemmatize(words, "other")


def test_document_key(spark):
    assert one(spark, text.document_key(F.lit("Deep Learning"))) == 79900580


def test_markers_sections_and_boxes(spark):
    assert one(spark, text.between_markers(F.lit("Title Abstract foo\nbar [abs]"))) == "foo bar"
    assert one(spark, text.between_markers(F.lit("no marker"))) is None
    found = one(spark, text.sections(F.lit("Abstract a Keywords b 1. Introduction c")))
    assert (found["abstract"], found["keywords"]) == ("Abstract a ", "Keywords b ")
    assert one(spark, text.joined_boxes(F.array(F.lit("a\n"), F.lit("b")))) == "\na\nb"


def chi(spark, *numbers, **options):
    return one(spark, vectors.chi_square(*[F.lit(n) for n in numbers], **options))


def test_chi_square(spark):
    assert chi(spark, 20, 30, 40, 100) == pytest.approx(11.160714, abs=1e-6)
    assert chi(spark, 20, 40, 30, 100) == pytest.approx(11.160714, abs=1e-6)
    assert chi(spark, 5, 30, 40, 100) == pytest.approx(11.160714, abs=1e-6)
    assert chi(spark, 5, 30, 40, 100, correction="yates") == pytest.approx(8.382937, abs=1e-6)
    assert chi(spark, 30, 30, 100, 100) is None
    assert chi(spark, 10**6, 2 * 10**6, 3 * 10**6, 10**7) > 0


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_cosine(spark):
    assert one(spark, vectors.cosine(doubles([1, 2]), doubles([2, 1]))) == pytest.approx(0.8)
    assert one(spark, vectors.cosine(doubles([1, 1]), doubles([1, 0]))) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.cosine(doubles([0, 0]), doubles([1, 2]))) == 0
    assert one(spark, vectors.cosine(doubles([1]), doubles([1, 2]))) is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=5), st.integers(1, 5))
def test_cosine_is_bounded_and_scale_free(spark, pairs, scale):
    x, y = zip(*pairs)
    a = one(spark, vectors.cosine(doubles(x), doubles(y)))
    assert -1.000001 <= a <= 1.000001
    assert one(spark, vectors.cosine(doubles([v * scale for v in x]), doubles(y))) == pytest.approx(a)


def test_idf_matches_ml(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "doc_id long, words array<string>")
    counts = features.term_counts(docs)
    inverse = features.inverse_frequencies(features.document_frequencies(counts), docs)
    assert {r["term"]: round(r["idf"], 9) for r in inverse.collect()} == {"a": round(math.log(4 / 2), 9), "b": round(math.log(4 / 3), 9)}
    terms = features.vocabulary(features.document_frequencies(counts))
    assert terms == ["a", "b"]
    _, weights, made = features.vectorise(docs, terms)
    assert list(weights.idf.toArray()) == pytest.approx([math.log(2), math.log(4 / 3)])
    assert list(made.orderBy("doc_id").first()["features"].toArray()) == pytest.approx([2 * math.log(2), math.log(4 / 3)])


def test_frequent_terms_are_weighed_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(features, "OFTEN", 2)
    words = [(i if i else None, ["all", "most" if i % 3 else "few", f"own{i}", f"own{i}", None]) for i in range(40)] + [(7, ["all", "own7"]), (None, None)]
    docs = spark.createDataFrame(words, "doc_id long, words array<string>")
    counts = kept(features.term_counts(docs))
    inverse = kept(features.inverse_frequencies(features.document_frequencies(counts), docs))
    weighed = features.tfidf(counts, inverse)
    want = counts.join(inverse, "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
    assert sorted(map(str, weighed.select("doc_id", "term", "tf", "tfidf").collect())) == sorted(map(str, want.collect()))
    assert weighed.count() == 121 - 1 and "BroadcastHashJoin" in weighed._jdf.queryExecution().sparkPlan().toString()


def test_counts_of_rows_and_of_repeated_ids(spark, tmp_path):
    rows = [(1, ["a", "b", "a", "\u00e9"]), (2, None), (3, []), (None, ["b", None, None])]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>").repartition(3)
    found = sorted(map(str, features.row_counts(docs).collect()))
    assert found == sorted(map(str, features.term_counts(docs).collect())) and len(found) == 5
    for texts in (["red red car", "red bus"], ["red red car", None, ""]):
        for ids in ([1, 2, 3], [1, 1, None], [None, None, 1]):
            spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
            want = features.term_counts(catalogue._worded(spark, str(tmp_path)))
            assert sorted(map(str, catalogue._counts(spark, str(tmp_path)).collect())) == sorted(map(str, want.collect()))


def test_pairs_degrees_and_components(spark):
    docs = spark.createDataFrame([(1, [3, 1, 2]), (2, [])], "doc_id long, topics array<int>")
    assert sorted(tuple(r) for r in graph.pair_counts(docs).collect()) == [(1, 2, 1), (1, 3, 1), (2, 3, 1)]
    edges = spark.createDataFrame([(0, 1), (1, 2), (4, 5)], "src int, dst int")
    vertices = spark.createDataFrame([(i,) for i in range(6)], "topic int")
    found = graph.connected_components(vertices, edges)
    assert {r["topic"]: r["component"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    assert sorted(r["size"] for r in graph.component_sizes(found).collect()) == [1, 2, 3]
    assert {r["topic"]: r["degree"] for r in graph.degrees(edges).collect()} == {0: 1, 1: 2, 2: 1, 4: 1, 5: 1}


def test_pairs_are_summed_up_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 60)
    deal = random.Random(4)
    for kind, names in (("int", list(range(-3, 9))), ("string", ["", "a", "\u00e9", "z", "\U0001f600"])):
        rows = [(None,), ([],), ([names[0]],), (names * 2,)] + [([deal.choice([*names, None]) for _ in range(deal.randint(0, 9))],) for _ in range(60)]
        want = {}
        for (row,) in rows:
            own = sorted({t for t in row or () if t is not None}) + [None] * (None in (row or ()))
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    want[a, b] = want.get((a, b), 0) + 1
        found = graph.pair_counts(spark.createDataFrame(rows, f"topics array<{kind}>").repartition(3))
        assert {(r["src"], r["dst"]): r["cnt"] for r in found.collect()} == want
        assert "Generate" not in found._jdf.queryExecution().sparkPlan().toString()
    held = np.array([[True] * 3, [True, False, True]])
    (made,) = graph._pairs(pa.array([[i for i in range(3) if row[i]] for row in held]))
    assert [c.to_pylist() for c in made] == [[0, 0, 1], [1, 2, 2], [1, 2, 1]]


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    vertices = spark.createDataFrame([(i,) for i in range(41)], "topic int")
    assert {r["component"] for r in graph.connected_components(vertices, edges).collect()} == {0}


def test_statistics_and_percentiles(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    found = graph.statistics(rows, "v").first()
    assert (found["n"], found["max"], found["min"]) == (3, 4.0, 1.0)
    assert found["stdev"] == pytest.approx(1.247219, abs=1e-6)
    docs = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "doc_id long, topics array<double>")
    found = explore.weight_percentiles(docs).first()
    assert (found["p90"], found["p50"]) == (pytest.approx(3.6), 2.0)
    assert explore.threshold_at(docs, 0.5) == 2.0


def test_percentiles_over_many_partitions(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, 0.0, rng.random(), rng.randint(0, 5) / 5]) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(7)
    found = explore.percentiles(rows, "v", (0.0, 0.123, 0.5, 0.999, 1.0)).first()
    want = [float(x) for x in np.quantile(values, [0.0, 0.123, 0.5, 0.999, 1.0])]
    assert [found[c] for c in ("p0", "p12", "p50")] == pytest.approx(want[:3]) and found[3] == pytest.approx(want[3])
    assert (found["least"], found["most"]) == (min(values), max(values))
    assert explore.percentiles(rows.limit(0), "v", (0.5,)).first()["p50"] is None


def test_component_count_and_order(spark):
    parts = spark.createDataFrame([(i, c) for i, c in enumerate([5, 2, 2, 9, 9, 7, 7, 7])], "topic int, component int")
    assert graph.component_count(parts).first()["components"] == 4
    assert [tuple(r) for r in graph.component_sizes(parts).collect()] == [(7, 3), (2, 2), (9, 2), (5, 1)]


def test_centrality_of_a_star(spark):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 5)] + [(1, 2, 1.0)], "src int, dst int, chi double")
    vertices = spark.createDataFrame([(i,) for i in range(6)], "topic int")
    found = {r["topic"]: r["centrality"] for r in graph.centrality(vertices, edges, rounds=60).collect()}
    matrix = np.zeros((6, 6))
    for a, b, w in [tuple(r) for r in edges.collect()]:
        matrix[a, b] = matrix[b, a] = w
    vector = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    assert [found[i] for i in range(6)] == pytest.approx((vector / vector.max()).tolist(), abs=1e-3)


def test_membership_includes_the_threshold(spark):
    assert one(spark, graph.major_topics(doubles([0.5, 0.2, 0.3]), 0.3)) == [0, 2]


def test_top_topics_prefer_the_smaller_index(spark):
    docs = spark.createDataFrame([(1, [0.2, 0.4, 0.4])], "doc_id long, topics array<double>")
    assert [(r["rank"], r["topic"]) for r in explore.topics_of_documents(docs, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_pages(spark):
    page = '<html><head><title>T</title><meta name="citation_title" content="A &amp; B"><meta name="citation_author" content="X"><meta name="citation_author" content="Y"></head><body><p class="abstract">some text</p><span class="Keyword">k</span><a href="/p/1">l</a></body></html>'
    pages = spark.createDataFrame([("http://h.org/a/b", page)], "url string, html string")
    paper = readers.proceedings_paper(pages, "SLML", keywords=("class", "Keyword")).first()
    assert (paper["authors"], paper["abstract"], paper["keywords"], paper["source"]) == ("X, Y", "some text", "k", "SLML")
    assert readers.listed_links(pages).first()["url"] == "http://h.org/p/1"
    assert not readers.needs_login(pages).first()["walled"]
    index = '<dl><dt>Paper</dt><dd><i>Ann, Bob</i> <a href="abs.html">abs</a> <a href="p.pdf">pdf</a></dd></dl>'
    entry = readers.journal_index(spark.createDataFrame([("http://j.org/v1/", index)], "url string, html string")).first()
    assert (entry["title"], entry["authors"], entry["abstract_url"], entry["url"]) == ("Paper", "Ann, Bob", "http://j.org/v1/abs.html", "http://j.org/v1/p.pdf")


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "papers")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "_id long, v string")
    again = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "_id long, v string")
    sinks.upsert(path, first)
    for _ in range(2):
        sinks.upsert(path, again, order="v")
        assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "e")]


def test_upsert_recovers_and_keeps_the_last(spark, tmp_path):
    path = tmp_path / "papers"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "_id long, v string")
    sinks.upsert(str(path), rows)
    path.rename(tmp_path / "papers.before")  # as a run leaves it that breaks off between its moves
    again = spark.createDataFrame([(2, "z"), (3, "d"), (2, "c")], "_id long, v string").coalesce(1)
    sinks.upsert(str(path), again)
    assert sorted(tuple(r) for r in spark.read.parquet(str(path)).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["papers"]
    assert sorted(tuple(r) for r in sinks.merged(rows, again.limit(0)).collect()) == [(1, "a"), (2, "b")]


def test_labels_numbers_and_similarities(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("Id,Label,Ambuguity\n0,Text Mining,\n1,\"Graph, large\",2\n")
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "labels.csv")).collect()] == [(0, "Text Mining", None), (1, "Graph, large", 2)]
    (tmp_path / "numbers").write_text("0.5\n-1e-3\n7\n")
    assert [r["value"] for r in readers.numbers(spark, str(tmp_path / "numbers")).collect()] == [0.5, -0.001, 7.0]
    found = spark.createDataFrame([(1, [0.5], 0.25)], "doc_id long, topics array<double>, similarity double")
    sinks.write_similarities(found, str(tmp_path / "hits"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "hits"), header=True).collect()] == [("1", "0.25")]


def test_layout_objects(spark):
    objects = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("LTTextBox", "a\n"), ("LTFigure", "x"), ("LTTextLine", "b"))])
    assert one(spark, text.text_of_layout(objects)) == "\na\nb"


def test_links_and_meta_in_any_form(spark):
    page = """<A class="x" HREF='/a?b=1&amp;c=2'>1</A><a href=/b>2</a><a name="n">3</a><META content="A &amp; B" name=citation_title><a
    href="/d">4</a><!-- <a href="/no"> -->"""
    pages = spark.createDataFrame([("http://h.org/x/", page), ("http://h.org/y/", None)], "url string, html string")
    assert [r["h"] for r in pages.select(html.hrefs(F.col("html")).alias("h")).collect()] == [["/a?b=1&c=2", "/b", "/d"], []]
    assert pages.select(html.meta(F.col("html"), "citation_title").alias("m")).first()["m"] == ["A & B"]
    links = lambda **o: sorted(r["url"] for r in readers.listed_links(pages, **o).collect())
    assert links() == ["http://h.org/a?b=1&c=2", "http://h.org/b", "http://h.org/d"]
    assert links(skip=1, keep=1) == ["http://h.org/b"] and links(skip=5) == []


def test_preprints_need_a_title(spark):
    page = '<h1 class="title">{}</h1><blockquote class="abstract">some\ntext</blockquote><meta name="citation_author" content="X">'
    pages = spark.createDataFrame([("u1", page.format("T")), ("u2", page.format("")), ("u3", "")], "url string, html string")
    assert [(r["title"], r["abstract"], r["authors"]) for r in readers.preprint(pages).collect()] == [("T", "some text", "X")]


def test_journal_listing(spark):
    entry = '<li class="x"><div class="txt"><h3><a href="/d/1">A &amp; B</a></h3></div><div class="authors"><a>Ann</a>; <a>Bob</a></div><div class="controls"><a href="/r">r</a><a href="/abs/1">a</a><a href="/pdf/1">p</a></div></li>'
    listing = spark.createDataFrame([("http://i.org/issue", f"<ul><li>menu</li>{entry}</ul>")], "url string, html string")
    found = [r.asDict() for r in readers.journal_listing(listing).collect()]
    assert found == [{"source": "IEEE", "title": "A & B", "authors": ["Ann", "Bob"], "keywords": "", "abstract_url": "http://i.org/abs/1", "url": "http://i.org/pdf/1"}]


def test_dispatch(spark):
    dispatcher = dispatch.Dispatcher(spark, 2)
    assert dispatcher.wait(dispatcher.submit(lambda a, b: a + b, 4, 4), 5) == 8
    assert dispatcher.wait(dispatcher.submit(lambda: spark.range(10).count())) == 10
    with pytest.raises(ValueError):
        dispatcher.wait(dispatcher.submit(int, "x"))
    slow = dispatcher.submit(lambda: spark.range(4, numPartitions=4).mapInPandas(lambda frames: (time.sleep(20) or f for f in frames), "id long").count())
    began = time.time()
    with pytest.raises(TimeoutError):
        dispatcher.wait(slow, 3)
    assert slow.exception(15) is not None and time.time() - began < 18
    dispatcher.close()


def test_tables_are_escaped(spark):
    rows = spark.createDataFrame([("<b>", "http://a/?x=\"1\"", None), ("t", "javascript:x", 2)], "title string, url string, n int")
    shown = pages.table(rows, {"title": "Title", "n": "No"}, ("title", "url"))
    assert '<a href="http://a/?x=&quot;1&quot;">&lt;b&gt;</a>' in shown and "<td>t</td><td>2</td>" in shown and "javascript" not in shown


def test_seeds(spark):
    assert readers.seeds_of(spark, "JMLR").count() == 6
    assert all(readers.seeds_of(spark, s).count() == 1 for s in ("NIPS", "SLML", "IEEE", "ARXIV"))


def test_edge_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 12.5)], "src int, dst int, w double")
    sinks.write_edges(edges, str(tmp_path / "e"), "w")
    assert [tuple(r) for r in readers.edges(spark, str(tmp_path / "e")).collect()] == [(0, 1, 12.5)]
    sinks.write_graph(edges, str(tmp_path / "g"), "w")
    assert spark.read.csv(str(tmp_path / "g"), header=True).columns == ["Source", "Target", "Weight", "Type"]


def test_binaries_keep_reasons(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"ok")
    (tmp_path / "b.bin").write_bytes(b"\xff")
    kept, rejected = readers.binaries(spark, str(tmp_path), lambda b: b.decode())
    assert [r["text"] for r in kept.collect()] == ["ok"]
    assert "UnicodeDecodeError" in rejected.first()["reason"]


@pytest.fixture(scope="module")
def corpus(spark):
    words = [["graph", "node", "edge", "path"], ["gene", "cell", "protein", "tissue"]]
    rows = [(i, " ".join(words[i % 2][(i + j) % 4] for j in range(12)), f"src{i % 3}") for i in range(24)] + [(24, None, "src0"), (25, "", "src1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_train_save_search_relate(spark, corpus, tmp_path):
    path = str(tmp_path / "model")
    log = jobs.train(corpus, path, (2, 3), iterations=10)
    chosen = log.where("chosen").collect()
    assert len(chosen) == 1 and chosen[0]["vocabulary_size"] == 8 and len(chosen[0]["document_concentration"]) == chosen[0]["k"]
    saved = spark.read.parquet(f"{path}/topicDistribution.parquet")
    assert saved.columns == [*corpus.columns, "topics"]
    for row in saved.collect():
        assert sum(row["topics"]) == pytest.approx(0 if row["doc_id"] >= 24 else 1)
    found = jobs.search(spark, path, "gene protein cell", 3).collect()
    assert len(found) == 3 and all(r["doc_id"] % 2 == 1 and r["understood"] and "gene" in r["text"] for r in found)
    assert not jobs.search(spark, path, "zzz", 2).first()["understood"]
    labels = spark.createDataFrame([(0, "Graphs"), (1, "Genes")], "Id int, Label string")
    page = jobs.search_page(spark, path, "gene protein cell", labels, 3).collect()
    assert [r["number"] for r in page] == sorted(r["number"] for r in page) and {r["number"] for r in page} == {1, 2, 3}
    assert [r["doc_id"] for r in page if r["rank"] == 1] == [r["doc_id"] for r in found] and all(r["label"] in ("Graphs", "Genes", None) for r in page)
    assert {r["rank"] for r in jobs.browse(spark, path, 0, labels, 2).collect()} >= {1, 2}
    loaded = topics.TopicPipeline.load(spark, path)
    again = loaded.infer(corpus).orderBy("doc_id").first()["topics"]
    assert again == pytest.approx(saved.orderBy("doc_id").first()["topics"])
    cells = topics.topic_matrix(loaded).groupBy("topic").agg(F.count("term").alias("n"), F.sum("weight").alias("w")).collect()
    assert len(cells) == chosen[0]["k"] and all(r["n"] == 8 and r["w"] == pytest.approx(1) for r in cells)
    report = jobs.relationship(spark, path, str(tmp_path / "graph"), 0.01, 0.0)
    assert report["components"].count() == report["vertices"].count()
    assert report["component_count"].first()["components"] == report["component_sizes"].count()
    jobs.export(spark, path, str(tmp_path / "store"))
    assert "topic_distribution" in spark.read.parquet(str(tmp_path / "store")).columns


def test_arrivals_are_scored_once(spark, corpus, tmp_path):
    path, source, out = str(tmp_path / "model"), str(tmp_path / "in"), str(tmp_path / "out")
    jobs.train(corpus, path, (2,), iterations=5)
    for first in (0, 12):
        corpus.where(F.col("doc_id").between(first, first + 11)).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            scoring.score_arrivals(spark, source, "doc_id long, text string, source string", path, out, str(tmp_path / "log")).awaitTermination(120)
        found = spark.read.parquet(out)
        assert sorted(r["doc_id"] for r in found.collect()) == list(range(first + 12))
    assert all(sum(r["topics"]) == pytest.approx(1) for r in found.collect())


def test_models_of_lemmas_survive(spark, corpus, tmp_path):
    plural = corpus.withColumn("text", F.regexp_replace("text", "(gene|cell|node)", "$1s")).withColumnRenamed("doc_id", "_id")
    rules = str(tmp_path / "rules")
    jobs.train(plural, rules, (2,), id_col="_id", iterations=5, lemmas="rules")
    assert {"gene", "node"} < set(topics.TopicPipeline.load(spark, rules).counter.vocabulary)
    assert jobs.search(spark, rules, "genes", 1, "_id").first()["understood"] and jobs.search(spark, rules, "gene", 1, "_id").first()["understood"]
    own = str(tmp_path / "own")
    jobs.train(plural, own, (2,), id_col="_id", iterations=5, lemmas=lambda w: w[:3])
    with pytest.raises(ValueError):
        jobs.search(spark, own, "gene", 1, "_id")
    assert jobs.search(spark, own, "generation", 1, "_id", lambda w: w[:3]).first()["understood"]


def test_single_candidates_need_no_scores(spark, corpus):
    assert topics.train(corpus, (2,), iterations=2, scores=False)[1] == [(2, None, None)]
    assert topics.train(corpus, (2,), iterations=2, scores=False)[0].partitions == 4


def test_registered_topic_queries_keep_every_term(spark, tmp_path):
    letters = "bcdfghjklmnpqrstvwxz"
    terms = [f"qq{a}{b}{c}" for a in letters for b in letters for c in letters][:5100]
    rows = [(i, " ".join(terms[i::60]), f"s{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    pipeline, scores = catalogue._pipeline(spark, str(tmp_path))[1]
    assert sorted(pipeline.counter.vocabulary) == sorted(terms) and [k for k, *_ in scores] == [5]
    assert pipeline.model.getMaxIter() == 100


def test_topic_models_hold_objects_and_read_texts_once(spark, corpus, tmp_path, monkeypatch):
    levels, calls, fit, clean = [], [], topics.LDA.fit, text.clean_tokens
    monkeypatch.setattr(topics.LDA, "fit", lambda self, made: levels.append(made.storageLevel) or fit(self.setMaxIter(3), made))
    monkeypatch.setattr(text, "clean_tokens", lambda *a: calls.append(1) or clean(*a))
    corpus.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.lda_doc_topics(spark, str(tmp_path)).collect()
    assert len(calls) == 1 and {r["doc_id"] for r in found} == set(range(26)) and all(sum(r["topics"]) == pytest.approx(float(r["doc_id"] < 24)) for r in found)
    catalogue.lda_model_selection(spark, str(tmp_path)).collect()
    assert len(calls) == 2 and len(levels) == 3
    assert not any(x.useMemory or x.useDisk for x in levels)  # else MLlib doesn't hold what it made of the rows


def test_written_counts_change_no_model(spark, corpus):
    pipeline, _ = topics.train(corpus, (2,), iterations=3, scores=False)
    words = topics.pinned(corpus, "doc_id", 4).select("doc_id", text.clean_tokens(F.col("text")).alias("words"))
    terms = features.vocabulary(features.document_frequencies(features.term_counts(words)))
    counter, _, made = features.vectorise(words, terms)
    plain = topics.LDA(k=2, seed=1, optimizer="online", maxIter=3).fit(made)
    assert pipeline.counter.vocabulary == counter.vocabulary and pipeline.model.topicsMatrix().toArray().tolist() == plain.topicsMatrix().toArray().tolist()
    given = topics.counted(corpus.select("doc_id", text.clean_tokens(F.col("text")).alias("words")))[2]
    both = [sorted(map(tuple, (pipeline.infer(d).select("doc_id", "topics").collect()))) for d in (corpus, given)]
    assert both[0] == both[1]


def test_clean_tokens_in_one_look_are_those_of_each_step(spark):
    texts = ["The Abstract of X: genes, I'll not a cid-map!", "  ", "", None, "\u0130stanbul na\u00efve KELVIN\u212a a b cc", "can't stop1word2the3THE keyword"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    steps = text.without_domain_words(text.without_stop_words(text.regex_tokens(F.col("t"))))
    found = rows.select(text.clean_tokens(F.col("t")).alias("one"), steps.alias("each")).collect()
    assert all(r["one"] == r["each"] for r in found) and any("genes" in r["one"] for r in found)


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<double>")
    assert [r["id"] for r in similarity.nearest(rows, doubles([1, 0]), "v", "id", 2).collect()] == [1, 2]


def test_title_of_page(spark):
    assert one(spark, html.title(F.lit("<title>a\nb</title>"))) == "a\nb"


def test_entities_that_a_tag_cuts_in_two(spark):
    pages = ["<title>a &amp;&am</title><style>p{}</style>&lt;b", "<p>x &amp;amp; &a<i>mp</i>", "<script>var t='</p>' &am</script>p&nbsp;", "&am", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, page string").select("id", html.all_text("page").alias("t"))
    assert [r["t"] for r in rows.orderBy("id").collect()] == ["a &&{}<b", "x &amp; &", "var t='</p>' &\xa0", "&am", ""]


@pytest.mark.parametrize("optimizer", ["online", "em"])
def test_bounds_are_those_of_the_model(spark, optimizer):
    deal = random.Random(3)
    docs = [(d, " ".join(deal.choices([f"w{chr(97 + v)}x" for v in range(d % 2 * 8, d % 2 * 8 + 12)], k=d % 30))) for d in range(60)]
    words = topics.pinned(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", 3).select("doc_id", F.split("text", " ").alias("words"))
    _, _, made = features.vectorise(words, [f"w{chr(97 + v)}x" for v in range(20)])
    model = topics.LDA(k=3, seed=1, optimizer=optimizer, maxIter=10).fit(made)
    likelihood, perplexity = topics.bounds(model, made)
    assert likelihood == pytest.approx(model.logLikelihood(made), rel=1e-4) and perplexity == pytest.approx(model.logPerplexity(made), rel=1e-4)


def test_scoring_takes_time_by_cells_not_by_the_vocabulary(spark):
    letters = "abcdefghijklmnopqrst"
    terms = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    began = time.time()
    _, _, made = features.vectorise(spark.range(600).select("id", F.split(F.repeat(F.lit("abca dabb tttt "), 3), " ").alias("words")), terms)
    model = topics.LDA(k=4, seed=1, maxIter=1).fit(made)
    topics.bounds(model, made)
    assert time.time() - began < 20
