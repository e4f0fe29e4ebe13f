"""Blocked topic models against the same model on one machine."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import blocks
from paperloom.plans import jobs


def test_digamma():
    euler = 0.5772156649015329
    assert np.allclose(blocks.digamma(np.array([1.0, 2.0, 0.5, 1e-3])), [-euler, 1 - euler, -euler - 2 * math.log(2), -1000.5755719318103], atol=1e-9)


def themed(seed, n=120, vocabulary=60, themes=3):
    """Documents of one theme each, with some common words, a repeated cell less and a term of one document."""
    deal, rows = random.Random(seed), []
    for d in range(n):
        for v in deal.sample(range(vocabulary), 12):
            if v % themes == d % themes or v < 6:
                rows.append((d, f"t{v}", float(deal.randint(1, 4))))
    return rows + [(n + 1, "once", 2.0), (n + 2, "t3", 0.0)]


def plain(spark, rows, k, rounds, steps=3, seed=1):
    """Batch variational Bayes with all documents and terms in one place."""
    keys = dict(spark.createDataFrame([(t,) for t in {r[1] for r in rows}], "t string").select("t", F.xxhash64("t")).collect())
    rows = sorted(r for r in rows if r[2] > 0)
    docs, terms = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(docs), len(terms)))
    for d, t, w in rows:
        x[docs.index(d), terms.index(t)] += w
    weights = blocks.start_of(np.array([keys[t] for t in terms]), k, seed)
    gamma = np.ones((len(docs), k))
    for _ in range(rounds):
        chances = np.exp(blocks.digamma(weights) - blocks.digamma(weights.sum(axis=0)))
        share = lambda g: np.exp(blocks.digamma(g) - blocks.digamma(g.sum(axis=1))[:, None])
        for _ in range(steps):
            e = share(gamma)
            gamma = 1 / k + e * ((x / np.maximum(e @ chances.T, 1e-100)) @ chances)
        e = share(gamma)
        weights = 1 / k + chances * ((x / np.maximum(e @ chances.T, 1e-100)).T @ e)
    return dict(zip(docs, gamma / gamma.sum(axis=1)[:, None])), dict(zip(terms, weights))


@pytest.mark.parametrize(("groups", "cut"), [(1, 1), (5, 3)])
def test_blocks_change_nothing(spark, groups, cut):
    rows = themed(1)
    cells = spark.createDataFrame(rows, "doc_id long, term string, weight double").repartition(3)
    docs, terms = blocks.fit(cells, 3, rounds=4, steps=3, groups=groups, blocks=cut)
    want_docs, want_terms = plain(spark, rows, 3, 4)
    got_docs, got_terms = {r["doc_id"]: r["topics"] for r in docs.collect()}, {r["term"]: r["weights"] for r in terms.collect()}
    assert got_docs.keys() == want_docs.keys() and got_terms.keys() == want_terms.keys()
    assert all(np.allclose(got_docs[d], want_docs[d], atol=1e-8) for d in got_docs)
    assert all(np.allclose(got_terms[t], want_terms[t], atol=1e-8) for t in got_terms)


def per_weight(cells, terms):
    row = blocks.fold_in(cells, terms).first()
    return row["log_likelihood"] / row["weight"]


def test_themes_are_found_chosen_and_resumed(spark):
    rows = themed(2, n=300)
    cells = spark.createDataFrame(rows, "doc_id long, term string, weight double").cache()
    train, held = cells.where("doc_id % 5 <> 0"), cells.where("doc_id % 5 = 0")
    docs, terms = blocks.fit(train, 3, rounds=8)
    theme = {}
    for r in docs.collect():
        if max(r["topics"]) > 0.6:
            theme.setdefault(r["doc_id"] % 3, []).append(int(np.argmax(r["topics"])))
    assert len(theme) == 3 and len({max(set(v), key=v.count) for v in theme.values()}) == 3
    inferred = blocks.infer(held, terms)
    assert inferred.count() == held.where("weight > 0").select("doc_id").distinct().count()
    options = {"rounds": 3, "groups": 2, "blocks": 2}
    started = time.time()
    best, scores, _ = blocks.choose(train, held, (1, 3), at_once=1, **options)
    middle = time.time()
    again, same, (_, chosen) = blocks.choose(train, held, (1, 3), at_once=2, **options)
    assert best == again == 3 and scores == pytest.approx(same) and scores[3] > scores[1]
    assert per_weight(held, chosen) == pytest.approx(scores[3])
    print(f"one after the other {middle - started:.1f} s, at once {time.time() - middle:.1f} s")
    # two steps over the halves come near one fit over all, and no term of the first is lost
    _, first = blocks.fit(train.where("doc_id % 2 = 0 or term = 'once'"), 3, rounds=8)
    _, both = blocks.fit(train.where("doc_id % 2 = 1 and term <> 'once'"), 3, rounds=8, prior=first)
    assert {r["term"] for r in both.collect()} == {r["term"] for r in terms.collect()}
    assert per_weight(held, both) > per_weight(held, terms) - 0.2
    assert sum(blocks.totals(both)) == pytest.approx(sum(r[2] for r in train.collect()) + len({r["term"] for r in terms.collect()}), rel=1e-6)


def test_jobs_in_blocks(spark, tmp_path):
    deal = random.Random(9)
    themes = ["graph vertex edge path cluster".split(), "prior posterior sampling likelihood bayes".split()]
    rows = [(i, " ".join(deal.choices(themes[i % 2], k=12)), b"x") for i in range(30)] + [(98, None, None), (99, "the a of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content binary")
    path = str(tmp_path / "model")
    log = jobs.train_blocks(docs, path, (1, 2), rounds=8, groups=2, blocks=2)
    assert [r["k"] for r in log.collect() if r["chosen"]] == [2]
    found = jobs.search_blocks(spark, path, "Vertex and edge of a graph", 8)
    assert found.count() == 8 and all(r["doc_id"] % 2 == 0 and r["similarity"] > 0.9 for r in found.collect())
    assert jobs.search_blocks(spark, path, "unknown words").count() == 0
    stored = spark.read.parquet(f"{path}/topicDistribution.parquet")
    assert stored.count() == 32 and stored.where("topics is null").count() == 2 and "content" not in stored.columns


def test_a_fit_leaves_its_results_alone(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "WAVE", 2)
    monkeypatch.setattr("paperloom.session._shared", lambda spark: str(tmp_path))
    docs, terms = blocks.fit(spark.createDataFrame(themed(2), "doc_id long, term string, weight double"), 3, rounds=2, groups=5, blocks=3)
    assert docs.count() == 121 and terms.count() == 61
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(d.written_to.split("/")[-1] for d in (docs, terms))
    want_docs, _ = plain(spark, themed(2), 3, 2, steps=8)
    assert all(np.allclose(r["topics"], want_docs[r["doc_id"]], atol=1e-8) for r in docs.collect())


def test_documents_in_parts_settle_as_at_once():
    make = np.random.default_rng(1)
    doc = np.sort(np.concatenate([np.arange(9), make.integers(0, 9, 80)]))
    term, weight, rows = make.integers(0, 20, len(doc)), make.random(len(doc)) + 0.1, make.random((20, 3))
    one = blocks.settle(doc, term, weight, np.ones((9, 3)), rows, 0.3, 4)
    for cells in (1, 15, 1000):
        assert all(np.allclose(a, b) for a, b in zip(one, blocks.settle_parts(doc, term, weight, np.ones((9, 3)), rows, 0.3, 4, cells)))


def test_exponentials_of_digamma():
    x = np.concatenate([np.geomspace(0.02, 1e9, 5000), [1.0]]).reshape(-1, 3)
    assert np.allclose(blocks.exp_digamma(x), np.exp(blocks.digamma(x)), rtol=1e-12) and blocks.exp_digamma(x)[-1, -1] == pytest.approx(math.exp(-0.5772156649015329), rel=1e-13)


def test_a_round_of_one_wave_is_written_once(spark, monkeypatch):
    written, kept = [], blocks.kept
    monkeypatch.setattr(blocks, "kept", lambda *a, **b: written.append(1) or kept(*a, **b))
    cells = spark.createDataFrame(themed(4, n=20), "doc_id long, term string, weight double")
    tables = []
    for rounds in (1, 3):
        written.clear()
        blocks.fit(cells, 3, rounds=rounds, groups=2, blocks=2)
        tables.append(len(written))
    assert tables[1] - tables[0] == 2


def test_settling_takes_the_rows_of_a_cell_once():
    make = np.random.default_rng(2)
    doc, rows = np.repeat(np.arange(600), 130), make.random((20_000, 45)) * 1e-4
    term, weight, gamma = make.integers(0, 20_000, len(doc)), make.random(len(doc)) + 0.1, np.ones((600, 45))
    began = time.process_time()
    for _ in range(9):  # what a step costs if each goes over all cells in the order of memory
        np.einsum("ij,ij->i", gamma[doc], rows[term])
    middle = time.process_time()
    blocks.settle(doc, term, weight, gamma, rows, 1 / 45, 8)
    assert time.process_time() - middle < middle - began


def test_cells_without_a_term_or_document_are_left_out(spark):
    rows = [(1, "a", 1.0), (1, None, 2.0), (None, "a", 3.0), (2, None, 1.0), (3, "b", 2.0)]
    docs, terms = blocks.fit(spark.createDataFrame(rows, "doc_id long, term string, weight double"), 2, rounds=2)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3] and sorted(r["term"] for r in terms.collect()) == ["a", "b"]
