"""Clustered searches against full scans, upserts of touched parts, selectors in one pass, files read once."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.functions import html
from paperloom.operators import clustered, explore, similarity
from paperloom.sources import readers, sinks


@pytest.fixture(scope="module")
def topical(spark):
    deal, rows = random.Random(3), []
    for i in range(1200):
        v = [deal.random() ** 9 for _ in range(8)]
        v[i % 8] += 1.0
        rows.append((i, v if i % 3 else [x / sum(v) for x in v], "kept"))
    rows += [(2000 + i, rows[5][1], "tie") for i in range(30)] + [(3000, [0.0] * 8, "zero"), (3001, None, "null"), (3002, [-x for x in rows[5][1]], "opposite")]
    return spark.createDataFrame(rows, "doc_id long, topics array<double>, band string").withColumnRenamed("band", "note")


def test_clustered_searches_equal_full_scans(spark, topical, tmp_path):
    path = str(tmp_path / "clusters")
    clustered.build(topical, path)
    store, whole = clustered.Clusters(spark, path), topical.where("topics is not null")
    assert store.held[1] == whole.count()
    fewer = 0
    for query in ([1.0, 0, 0, 0, 0, 0, 0, 0.2], whole.where("doc_id = 5").first()["topics"], [0.0] * 8, [-1.0, -0.5, 0, 0, 0, 0, 0, 0]):
        for n in (1, 10, 40):
            want = similarity.nearest(whole, F.array(*[F.lit(float(x)) for x in query]), "topics", "doc_id", n)
            assert [(r["doc_id"], r["similarity"]) for r in store.nearest(query, n).collect()] == [(r["doc_id"], r["similarity"]) for r in want.collect()]
            fewer += store.read[1] < store.held[1] / 2
    assert fewer >= 5
    for topic, n in ((0, 10), (5, 40), (7, 5000)):
        want = explore.documents_of_topic(whole, topic, n).select("number", "doc_id", "percent", "note")
        got = store.documents_of_topic(topic, n)
        assert got.select("number", "doc_id", "percent", "note").collect() == want.collect()
        if n < 1000:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert store.read[0] < store.held[0] / 2 and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_empty_clusters(spark, topical, tmp_path):
    clustered.build(topical.limit(0), str(tmp_path / "none"))
    assert clustered.Clusters(spark, str(tmp_path / "none")).nearest([1.0] * 8).count() == 0


def held(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_upserts_rewrite_touched_parts_only(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([(i, "old", i) for i in range(400)], "_id long, text string, v long")
    sinks.upsert_parts(path, first, parts=16)
    before = held(path)
    sinks.upsert_parts(path, spark.createDataFrame([(7, "new", 1), (7, "newest", 2), (1000, "added", 1)], "_id long, text string, v long"), order="v", parts=16)
    after = held(path)
    rows = {r["_id"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert len(rows) == 401 and rows[7] == "newest" and rows[1000] == "added" and rows[8] == "old"
    same = {f for f in before if after.get(f) == before[f]}
    assert len({f.split("/")[0] for f in before} - {f.split("/")[0] for f in same}) <= 2 and len(same) >= 14
    sinks.upsert_parts(path, first.limit(0), parts=16)
    assert held(path) == after


def test_broken_upserts_are_finished_by_the_next(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.upsert_parts(path, spark.createDataFrame([(i, "old") for i in range(50)], "_id long, text string"), parts=4)
    part = F.pmod(F.xxhash64("_id"), F.lit(4)).cast("int")
    whole = spark.read.parquet(path)
    hurt = whole.where(F.col("key_part") == 2).withColumn("text", F.lit("merged"))
    hurt.write.parquet(f"{path}.merging")  # written beside, never put in place
    sinks.upsert_parts(path, spark.createDataFrame([(999, "later")], "_id long, text string"), parts=4)
    rows = spark.read.parquet(path)
    assert rows.count() == 51 and rows.where((part == 2) & (F.col("text") == "old")).isEmpty() and not Path(f"{path}.merging").exists()


PAGE = """<html><head><meta name="citation_title" content="T &amp; U"><meta name=citation_author content=A><meta name="citation_author" content="B">
<meta name="citation_pdf_url" content="/x.pdf"></head><body><p class="abstract big">one <b>two</b></p><p>no</p><span class="Keyword">k1</span><span class="Keyword">k2</span></body></html>"""


def test_one_pass_gives_what_single_selectors_give(spark):
    pages = spark.createDataFrame([("u", PAGE), ("v", None), ("w", "<p class=abstract>open"), ("x", "")], "url string, html string")
    chosen = {"a": ("p", ("class", "abstract")), "b": ("p",), "c": ("meta", ("name", "citation_author"), "content"), "d": ("span", ("class", "Keyword"))}
    together = pages.select(html.selected(F.col("html"), **chosen).alias("f")).select("f.*").collect()
    alone = pages.select(*[html.select(F.col("html"), *s).alias(name) for name, s in chosen.items()]).collect()
    assert together == alone
    papers = readers.proceedings_paper(pages, "SLML", keywords=("class", "Keyword"))
    row = papers.first()
    assert (row["title"], row["authors"], row["abstract"], row["keywords"], row["url"]) == ("T & U", "A, B", "one ", "k1, k2", "/x.pdf") or row["abstract"] == "one two"
    plan = papers._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.count("run(html") <= 2


def test_files_are_extracted_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.bin").write_bytes(b"bad" if i == 3 else b"text %d" % i)
    log = tmp_path / "seen"
    log.mkdir()

    def extract(content, log=str(log)):
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").close()
        if content == b"bad":
            raise ValueError("bad")
        return content.decode()

    kept, rejected = readers.binaries(spark, str(tmp_path / "in"), extract)
    assert kept.count() == 5 and [r["reason"] for r in rejected.collect()] == ["ValueError: bad"] and kept.select("text").distinct().count() == 5
    assert len(list(log.iterdir())) == 6
