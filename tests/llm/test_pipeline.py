"""The pipeline's stages against brute force, on awkward rows, and the registration of its queries."""

import hashlib
import importlib
import math
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, documents, groups_brute, line_brute, words
from tokenizers import Tokenizer

from paperloom.llm import linededup, packing, toxicity

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
BASE = " ".join(f"b{i}" for i in range(60))
LINES = "first line here\nsecond line here\nthird line here"
TEXTS = [
    BASE, BASE.replace("b30", "z"), BASE, None, "", " \n ", "one", "one", "you are a worthless idiot, worthless", LINES, f"own\n{LINES}\nend", LINES,
    "a b c d e", "A b C d e", "x y\nx y\nx y\nx y", " ".join(f"w{i % 977}" for i in range(9000)), " ".join(f"p{i}" for i in range(55)), "q\n" + " ".join(f"p{i}" for i in range(55)) + "\nr",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows: a null id, a row twice, one id with two texts, clashing names."""
    rows = documents(spark, TEXTS)
    more = rows.where("doc_id = 0").unionByName(rows.where("doc_id = 12").withColumn("text", F.lit("another text")))
    nameless = rows.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long"))
    clashing = rows.unionByName(more).unionByName(nameless)
    for name in ("row", "hash", "n", "target", "offset", "mix_size", "row_id", "piece", "toxic", "runs", "f", "component"):
        clashing = clashing.withColumn(name, F.lit(name))
    return clashing.cache()


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None


def test_toxic_documents_go(spark, docs):
    grader = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    grader.lexicon = toxicity.Lexicon({"worthless$": 1.0, "idiot": 1.0})
    grader.weights = __import__("numpy").array([9.0, 0, 0, 9.0, 0, -4.0])
    want = bag(r for r in docs.collect() if grader.grade(r["text"])[0] < 0.3)
    assert bag(toxicity.clean(docs, grader).collect()) == want and len(TEXTS) + 2 == sum(want.values())
    kept = STAGES["toxicity"](spark, docs, DATA)
    assert kept.columns == docs.columns and not bag(kept.collect()) - bag(docs.collect())


def test_repeated_lines_go(spark, docs):
    found = STAGES["line_dedup"](spark, docs, DATA)
    assert found.columns == docs.columns
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id <> 12")
    rows = sorted(plain.collect(), key=lambda r: r["doc_id"])
    want = {}
    for r, (_, kept) in zip(rows, line_brute([r["text"] for r in rows], 2, linededup.LONG_WORDS)):
        if kept == r["text"] or (kept and WORD.search(kept)):
            want[r["doc_id"]] = kept
    got = STAGES["line_dedup"](spark, plain, DATA).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] and r["text"] != TEXTS[r["doc_id"]])


def test_one_of_each_group_stays(spark, docs):
    rows = docs.collect()
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, rows[i]["text"] or ""))
    groups = groups_brute([rows[i]["text"] for i in order])
    got = STAGES["ngram_join"](spark, docs, DATA)
    assert got.columns == docs.columns
    left = got.collect()
    empty = [r for r in rows if not words(r["text"])]
    assert bag(r for r in left if not words(r["text"])) == bag(empty)
    ids = defaultdict(set)
    for k, (n, c) in groups.items():
        if n:
            ids[c].add(rows[order[k]]["doc_id"])
    firsts = sorted(min((i for i in own if i is not None), default=-1) for own in ids.values())
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left if words(r["text"])) == firsts


def test_sources_are_mixed(spark, docs):
    """The sampling by plain loops over whole, sorted sources."""
    rows = docs.collect()
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    sizes = {s: sum(len(words(r["text"])) for r in rows if r["source"] == s) for s in sources}
    weight, targets, left = {s: i % 3 + 1 for i, s in enumerate(sources)}, {}, sum(sizes.values())
    open_ = set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        for s in full or list(open_):
            targets[s] = 3 * sizes[s] if full else level * weight[s]
            left -= targets[s]
            open_.remove(s)
    want = Counter()
    for s in sources:
        offset = int(hashlib.md5(f"0|{'n' if s is None else 's' + s}".encode()).hexdigest()[:4], 16) / 65536
        digest = lambda r: hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
        down = lambda r: digest(r)[3] in "13579bdf"
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (down(r), len(words(r["text"])) * (-1 if down(r) else 1), digest(r)[:3], r["doc_id"] is not None, r["doc_id"] or 0))
        each = targets[s] / sizes[s] if sizes[s] else 0
        for i, r in enumerate(own):
            if words(r["text"]):
                want[r["doc_id"], len(words(r["text"]))] += min(3, math.floor((i + 1) * each + offset) - math.floor(i * each + offset))
    got = STAGES["mixing"](spark, docs, DATA)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], len(words(r["text"]))) for r in got.collect()) == +want


def test_sequences_hold_every_token(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = STAGES["packing"](spark, docs.drop("row_id", "piece"), DATA).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["row_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == r["length"]
    whole = [(own[0]["doc_id"], tuple(x for r in sorted(own, key=lambda r: r["piece"]) for x in r["ids"])) for own in pieces.values()]
    assert Counter(whole) == Counter((r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0)) for r in docs.collect())
    for own in places.values():
        ends = [o + n for o, n in sorted(own)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(own)] and ends[-1] <= packing.LENGTH
    assert len(places) <= len(packing.best_fit([r["length"] for r in got], packing.LENGTH))


def test_empty_tables_pass_through(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, DATA)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_stages_keep_their_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, DATA).cache()
        assert out.columns == columns, name
        assert 0 < out.count(), name
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, DATA)
    assert last.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
    assert last.select("row_id").distinct().count() == seen.count()
