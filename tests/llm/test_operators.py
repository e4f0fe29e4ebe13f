"""The training-data operators against brute force, round trips and awkward rows."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import ann, audio, jaccard, linededup, mixing, packing, substrings, toxicity, urlfilter, warc
from paperloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977}" for i in range(6000))
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g", "a b c d e f g", "ÉTÉ  Été x <|endoftext|>", LONG, LONG + " tail", "same\nline\nsame\nline\n", "same\nline\nother"]


def documents(spark, texts, first=0):
    """Rows with a column that clashes with names used inside, and a null source."""
    rows = [(first + i, t, "en", None if i == 3 else f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return WORD.findall(t or "")


# 1


def test_url_rules_and_models(spark):
    good = [f"https://a{i}.example.com/fr/{i}" for i in range(60)]
    bad = [f"http://b{i}.spam.net/es/{i}?buy=cheap" for i in range(60)]
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1", "http://example.com/en/", "http://x.example.com", "http://com/", "https://good.example.org/fr/7", "http://q.spam.org/es/9?buy=cheap"]
    urls = good + bad + odd
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert len(found) == len(urls)
    row = lambda u: found[urls.index(u)]
    assert (row(None)["host"], row(None)["path"], row(None)["rule"]) == ("", "", None)
    assert (row("HTTP://WWW.Example.COM/en/1")["host"], row("HTTP://WWW.Example.COM/en/1")["rule"]) == ("www.example.com", "www.example.com/en/")
    assert (row("http://example.com/en/")["rule"], row("http://example.com/en/")["verdict"]) == ("example.com/en/", "block")
    assert row("http://x.example.com")["rule"] is None and row("http://com/")["rule"] == "com/"
    assert all(found[i]["verdict"] == "allow" for i in range(60)) and all(found[60 + i]["verdict"] == "block" for i in range(60))
    assert row("https://good.example.org/fr/7")["verdict"] == "allow" and row("http://q.spam.org/es/9?buy=cheap")["verdict"] == "block"
    long = spark.createDataFrame([(-1, "http://spam.example.net/es/" + "a?b" * 300_000), (-2, "é" * 400_000)], "page_id long, url string")
    found = {r["page_id"]: r for r in urlfilter.judge(pages.select("page_id", "url").unionByName(long)).collect()}
    assert (found[-1]["rule"], found[-1]["path"], found[-2]["host"], len(found)) == ("net/es/", "/es/a", "", len(urls) + 2)
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages.where("page_id < 60")).collect()} == {"allow"}


def test_url_models_are_distributions():
    symbols, at, _ = urlfilter._positions(["http://a.b/c", "http://a.b/d"])
    keys = urlfilter._keys(symbols, at)
    key, n = np.unique(keys, return_counts=True)
    model = urlfilter.CharacterModels(key, n, n)
    for k in range(urlfilter.ORDER + 1):
        assert np.allclose(model.share[0][k].sum(axis=1) + model.rest[0][k], 1, atol=1e-5)
    assert np.allclose(model.score(["http://a.b/c", None]), 0)


def exact_scores(urls, ok):
    """Scores by dicts over whole contexts: Witten-Bell, both sides trained on what isn't in the left-out fold."""
    coded = lambda u: [*["^"] * urlfilter.ORDER, *u, "$"]
    sides = []
    for side in (True, False):
        counts = defaultdict(lambda: defaultdict(int))
        for u, y in zip(urls, ok):
            if y is side and int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % urlfilter.FOLDS:
                c = coded(u)
                for i in range(urlfilter.ORDER, len(c)):
                    for k in range(urlfilter.ORDER + 1):
                        counts[tuple(c[i - k : i])][c[i]] += 1
        sides.append(counts)

    def chance(counts, c, i):
        p = 1 / urlfilter.SYMBOLS
        for k in range(urlfilter.ORDER + 1):
            seen = counts.get(tuple(c[i - k : i]))
            if seen:
                below = sum(seen.values()) + len(seen)
                p = seen.get(c[i], 0) / below + len(seen) / below * p
        return p

    out = []
    for u in urls:
        c = coded(u)
        at = range(urlfilter.ORDER, len(c))
        out.append(sum(np.log(chance(sides[0], c, i)) - np.log(chance(sides[1], c, i)) for i in at) / len(at))
    return out


def test_url_scores_are_of_exact_contexts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    name = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 12))
    urls = [f"https://{name()}.{('com', 'net', 'org')[i % 3]}/fr/{name()}" for i in range(900)]
    urls += urls[:40]
    want = exact_scores(urls, [(True, False, None)[("com", "net", "org").index(u.split("/")[2][-3:])] for u in urls])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for rows in (500_000, 1000):
        monkeypatch.setattr(urlfilter, "BUCKET_ROWS", rows, raising=False)
        found = {r["page_id"]: r["score"] for r in urlfilter.judge(pages).collect()}
        assert np.allclose([found[i] for i in range(len(urls))], want, rtol=0, atol=1e-8)


# 2


def test_toxicity_learns_and_scores(spark):
    rng = np.random.default_rng(0)
    plain = ["table", "river", "window", "green", "walk", "quiet", "paper", "stone", "cloud", "bread"]
    texts, labels = [], []
    for i in range(400):
        body = " ".join(rng.choice(plain, 30))
        toxic = i % 4 == 0
        texts.append(f"{body}. you are a {'grumbleface' if toxic else 'friend'} {body}")
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, [*texts, None, "", "he said grumbleface " + LONG])
    labels = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    grader = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, grader).collect()
    assert len(rows) == 403 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows if r["doc_id"] < 400)
    assert all("targeted" in h["marks"] for h in next(r for r in rows if r["doc_id"] == 0)["clauses"])
    assert {r["predicted"] for r in rows if r["doc_id"] in (400, 401)} == {0}
    assert toxicity.clean(docs, grader).where("doc_id < 400").count() == 300
    assert toxicity.fit(docs, labels.limit(0)).weights is None
    assert toxicity.score(docs.limit(0), grader).count() == 0


def test_grammar_marks_clauses():
    lexicon = toxicity.Lexicon({"moron$": 1.0, "foul": 0.5})
    marks = lambda t: [sorted(m) for _, _, _, m in lexicon.matches(t)]
    assert marks("you moron") == [["targeted"]]
    assert marks("not a moron. moron") == [["negated"], []]
    assert marks("they said foulness") == [["reported", "targeted"]]
    assert marks("a moron you") == [["targeted"]]
    assert marks("I will kill you") == [["threat"]] and marks("I will not kill you") == [["negated", "threat"]]
    assert marks("I will kill it") == marks("He beat the record") == marks("They had to kill the process") == []
    assert marks("the word moron") == [["reported"]]
    assert marks("never kill. moron never kill") == [[]]
    assert marks("oxymoron morons") == []
    assert [(a, b, w) for a, b, w, _ in lexicon.matches("x. foul moron foul! y foul")] == [(2, 19, 2.0), (19, 26, 0.5)]


def clauses_brute(tokens, stems):
    """(weight, marks) of each clause with an insult or harm, by looking back and ahead from every word."""
    out, clause = [], []
    for t in [*tokens, "."]:
        if t not in ".!?;\n":
            clause.append(t)
            continue
        kind = [max([w for s, w in stems.items() if (t_ == s[:-1] if s.endswith("$") else t_.startswith(s))], default=0) for t_ in clause]
        hits, marks, of_harm, modal = [], set(), set(), {}
        for i, w in enumerate(clause):
            near = lambda group, steps: any(x in group and not kind[j] for j, x in enumerate(clause[max(0, i - steps) : i], max(0, i - steps)))  # noqa: E731, B023
            harm = not kind[i] and w in toxicity.HARMS
            if kind[i] or harm:
                own = {"negated"} if near(toxicity.NEGATIONS, 3) else set()
                own |= {"reported"} if near(toxicity.REPORTS, i) or near(toxicity.NAMINGS, 1) else set()
                if kind[i]:
                    hits.append(kind[i])
                    marks |= own | ({"targeted"} if near(toxicity.TARGETS, 4) else set())
                else:
                    of_harm |= own
                    modal[i] = near(toxicity.MODALS, 4)
            if not kind[i] and w in toxicity.TARGETS:
                # the last harm word within three words that a modal stands before
                if any(modal.get(j) for j in range(i - 3, i)):
                    hits.append(1.0)
                    marks.add("threat")
            if not kind[i] and w in toxicity.TARGETS and any(kind[max(0, i - 2) : i]):
                marks.add("targeted")
        if hits:
            out.append((sum(hits), sorted(marks | of_harm if "threat" in marks else marks)))
        clause = []
    return out


def test_grammar_against_brute_force():
    rng, stems = np.random.default_rng(11), {"moron$": 1.0, "foul": 0.5, "foulest": 0.75}
    only = lambda group: [w for w in group if sum(w in g for g in (toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, toxicity.NAMINGS, toxicity.MODALS, toxicity.HARMS)) == 1]
    vocabulary = ["moron", "fouling", "foulest", "foul", "kill", "hurt", "stone", "cloud", "moronic", ".", ";", "walk", "green"]
    for group in (toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS, toxicity.NAMINGS, toxicity.MODALS):
        vocabulary += only(group)[:4]
    lexicon = toxicity.Lexicon(stems)
    for _ in range(600):
        tokens = rng.choice(vocabulary, rng.integers(0, 25)).tolist()
        assert [(w, sorted(m)) for _, _, w, m in lexicon.matches(" ".join(tokens))] == clauses_brute(tokens, stems)


def test_toxicity_repeated_rows_and_held_out_accuracy(spark):
    """Labels that the model never saw, on a whole table; repeated rows and rows with equal texts get equal scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.join(labels, "doc_id").select(*docs.columns, "toxic")
    grader = toxicity.fit(docs, labels)
    rows = toxicity.score(marked.unionByName(marked.where("doc_id % 7 = 0")), grader).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert len({(r["doc_id"], r["score"]) for r in rows}) == len({r["doc_id"] for r in rows}) < len(rows)
    unseen = [r for r in rows if r["held_out"]]
    caught = [r["predicted"] for r in unseen if r["toxic"]]
    alone = [1 - r["predicted"] for r in unseen if not r["toxic"]]
    assert np.mean(caught) >= 0.9 and np.mean(alone) >= 0.98
    assert_scores_follow_the_grammar(grader)


def assert_scores_follow_the_grammar(grader):
    """Marked clauses rank as they read, whatever the labels showed."""
    stem = next(s.rstrip("$") for s in sorted(grader.lexicon.stems, key=lambda s: (-grader.lexicon.stems[s], s)))
    score = lambda t: grader.grade(t)[0]
    base = score("He walked home.")
    assert score("He beat the record.") == score("They had to kill the process.") == base < toxicity.PREDICTED_FROM
    assert score(f"You are a {stem}.") >= score(f"A {stem} came.") >= toxicity.PREDICTED_FROM
    for milder in (f"You are not a {stem}.", f"The word {stem} has five letters.", f"She said they called a man {stem}."):
        assert base <= score(milder) < score(f"A {stem} came.") and score(milder) < toxicity.PREDICTED_FROM
    assert score("I will kill you.") >= toxicity.PREDICTED_FROM > score("I will not kill you.")


def test_kinds_without_labels_keep_their_prior():
    x, y = np.zeros((200, len(toxicity.KINDS))), np.zeros(200)
    x[:100, toxicity.KINDS.index("negated")], y[:100] = 1.0, 1  # labels against the order: negated insults toxic, nothing else seen
    w = dict(zip((*toxicity.KINDS, "base"), toxicity.logistic(x, y)))
    assert w["threat"] >= w["plain"] and w["targeted"] >= w["plain"] and w["negated"] <= w["plain"] / 2 + 1e-9 and w["reported"] == pytest.approx(0.5)


# 3


def test_mix_meets_targets(spark, docs, none):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "abc"[i % 3] if i % 10 else "a", 0, "x") for i in range(3000)]
    many = spark.createDataFrame(rows, docs.schema)
    found = mixing.mix(many).groupBy("row.source").agg(F.first("mix_source_size").alias("size"), F.first("mix_target").alias("target"), F.sum(F.col("mix_copies") * F.col("mix_size")).alias("taken"), F.max("mix_copies").alias("most")).collect()
    assert sum(r["target"] for r in found) == pytest.approx(sum(r["size"] for r in found))
    assert all(abs(r["taken"] - r["target"]) <= 40 and r["most"] <= 3 for r in found)
    odd = mixing.mix(docs.unionByName(docs))
    assert odd.count() == 2 * len(TEXTS) and odd.where("mix_size = 0 and mix_copies > 0").count() == 0
    assert {r["mix_size"] for r in odd.collect()} == {len(words(t)) for t in TEXTS}
    again = [sorted(tuple(r) for r in mixing.mix(docs.repartition(n)).select("row.doc_id", "mix_copies").collect()) for n in (1, 5)]
    assert again[0] == again[1]
    assert mixing.mix(none).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_mix_with_clashing_names(docs):
    clashing = docs.select("*", *[F.lit(n).alias(n) for n in ("row", "target", "offset", "source_size", "mix_size", "mix_copies", "mix_key", "n", "mix_row")])
    kept = mixing.mixed(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in mixing.mixed(docs).collect())


def test_mix_offset_is_fair(docs):
    """Over many seeds a document is drawn as often as it is expected."""
    drawn = defaultdict(int)
    for seed in range(12):
        for r in mixing.mix(docs, seed=seed).select("row.doc_id", "mix_copies", (F.col("mix_target") / F.col("mix_source_size")).alias("each"), "mix_size").collect():
            drawn[r["doc_id"], r["each"], r["mix_size"]] += r["mix_copies"]
    assert all(abs(n - 12 * each) <= 7 for (_, each, size), n in drawn.items() if size)


def test_mix_caps_small_sources(spark, docs):
    rows = [(i, "w " * 10, "en", "a" if i < 5 else "c" if i < 100 else "d", 0, "x") for i in range(200)]
    found = {r["source"]: r for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).groupBy("row.source").agg(F.first("mix_target").alias("t"), F.sum("mix_copies").alias("n")).collect()}
    sizes = {"a": 50, "c": 950, "d": 1000}
    weights = {"a": 1, "c": 2, "d": 3}
    targets, open_ = {}, dict(weights)
    left = 2000.0
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 3 * sizes[s]]
        for s in full or list(open_):
            targets[s] = 3.0 * sizes[s] if full else level * open_[s]
            left -= targets[s]
            del open_[s]
    assert all(found[s]["t"] == pytest.approx(targets[s]) for s in sizes)
    assert found["a"]["n"] == 15


# 4


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (7, "http://b c\n", "short"), (8, "http://b", "short"), (9, "u", None), (10, "u", ""), (11, "é", "ü" * 600), (None, "u", big), (5, "http://a/5", big)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.round_trip(pages).collect()
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in found)
    assert got == sorted([(1, "revisit", 5), (5, "response", 0), (5, "response", 0), (3, "revisit", 5), *[(i, "response", 0) for i in (7, 8, 9, 10, 11)], (0, "response", 0)])
    by_id = defaultdict(set)
    for i, _, h in rows:
        raw = (h or "").encode()
        by_id[i].add((len(raw), hashlib.sha1(raw).hexdigest()))
    assert all((r["payload_bytes"], r["payload_digest"]) in by_id[r["page_id"]] for r in found)
    path = str(tmp_path / "archive")
    warc.write(pages, path, compression="none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "archive").glob("part-*")))
    parsed = list(warc.parse(raw))
    assert len(parsed) == len(rows) and all(b"\n" not in v for head, _ in parsed for v in head.values())
    assert all(re.fullmatch(rb"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", head[b"warc-date"]) for head, _ in parsed)
    assert warc.round_trip(pages.limit(0)).count() == 0


def warc_record(kind, block, *more):
    lines = [b"WARC/1.0", b"warc-type: " + kind, *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_reads_other_archives(spark, tmp_path):
    """A member a record, several records a member, no compression; base-32 and absent digests; other types."""
    http, payload = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n", b"body \r\n\r\n WARC/1.0\r\n"
    base32 = b"WARC-Payload-Digest:sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
    kind = b"Content-Type: application/http;msgtype=response"
    made = [warc_record(b"warcinfo", b"a: b\r\n"), warc_record(b"response", http + payload, kind, base32), warc_record(b"request", b"GET / HTTP/1.1\r\n\r\n"), warc_record(b"response", http + payload, kind, b"WARC-Page-ID: 7"), warc_record(b"resource", b"")]
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(b"".join(made[:2])) + gzip.compress(b"".join(made[2:])))
    (tmp_path / "plain.warc").write_bytes(b"".join(made))
    found = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["record_type"] for r in found) == sorted(["warcinfo", "response", "request", "response", "resource"] * 3)
    assert {bytes(r["payload"]) for r in found if r["record_type"] == "response"} == {payload}
    assert sorted(r["page_id"] for r in found if r["page_id"]) == [7, 7, 7]
    whole = gzip.compress(b"".join(made))
    for broken in (whole[:-20], b"".join(made)[:-3], made[0].replace(b"WARC/1.0", b"HTTP/1.0"), warc_record(b"response", http + b"x", kind, base32)):
        with pytest.raises(ValueError):
            [warc._row(*r) for r in warc.parse(broken)]


def test_warc_very_long_payloads(spark):
    digits = F.concat(F.lit("012345678"), F.col("id").cast("string"))
    pages = spark.range(1, 4).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.expr("id = 2").alias("long"), digits.alias("html"))
    pages = pages.withColumn("html", F.when(F.col("long"), F.repeat("html", F.lit(11_000_000))).otherwise(F.col("html")))
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["payload_digest"]) for r in warc.round_trip(pages).collect()}
    assert found[2] == (110_000_000, "response", hashlib.sha1(b"0123456782" * 11_000_000).hexdigest())
    assert [found[i][0] for i in (1, 3)] == [10, 10]


# 5


def test_pieces_match_the_tokenizer(docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(docs.unionByName(docs.where("doc_id = 4")), VOCABULARY, with_ids=True).collect()
    for i, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: (r["piece"], r["sequence_id"]))
        if i == 4:
            assert len(own) == 2
            own = own[:1]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [s for s, _ in packing.cut(len(ids))]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.LENGTH


def test_encoder_on_odd_blanks():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng, letters = np.random.default_rng(0), [" ", " ", "a", "'s", "\n", "\t", "1", ".", "é", "　", "<|endoftext|>"]
    for _ in range(400):
        t = "".join(rng.choice(letters, rng.integers(0, 14)))
        assert np.frombuffer(packing.encoder(VOCABULARY).encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_local_search_never_loses_and_helps():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(400, 1200, 1500).tolist(), rng.integers(1, 2048, 800).tolist(), [2048] * 5, [], [1]):
        first, bins = packing.best_fit(sizes, 2048), packing.pack_sizes(sizes)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert -(-sum(sizes) // 2048) <= len(bins) <= len(first)
    hard = rng.integers(400, 1200, 1500).tolist()
    assert len(packing.pack_sizes(hard)) < len(packing.best_fit(hard, 2048))


def fewest_bins(sizes, capacity):
    """By dynamic programming over subsets: (bins, fill of the last one)."""
    best = [(0, capacity)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for mask in range(1, 1 << len(sizes)):
        for i, s in enumerate(sizes):
            if mask >> i & 1:
                n, fill = best[mask ^ (1 << i)]
                best[mask] = min(best[mask], (n, fill + s) if fill + s <= capacity else (n + 1, s))
    return best[-1][0]


def test_local_search_against_exact_packing():
    rng, exact, found = np.random.default_rng(2), 0, 0
    for _ in range(150):
        sizes = rng.integers(1, 61, rng.integers(1, 11)).tolist()
        fewest, bins = fewest_bins(sizes, 100), packing.pack_sizes(sizes, 100)
        assert fewest <= len(bins) <= len(packing.best_fit(sizes, 100))
        exact, found = exact + fewest, found + len(bins)
    assert found <= exact * 1.02


def test_exchanges_of_each_kind():
    """Bins that only one kind of exchange improves, each of which empties one or fills one up."""
    for bins, capacity, want in (
        ([[6], [4]], 10, [[4, 6]]),  # a move
        ([[6, 3], [4, 2]], 10, [[6, 4], [3, 2]]),  # one for one
        ([[3, 3, 3], [7]], 10, [[3, 7], [3, 3]]),  # one of theirs for two of ours
        ([[5, 4], [3, 2]], 10, [[5, 3, 2], [4]]),  # two of theirs for one of ours
    ):
        sizes = [s for b in bins for s in b]
        numbered, at = [], 0
        for b in bins:
            numbered.append(list(range(at, at + len(b))))
            at += len(b)
        before = sum(sum(b) ** 2 for b in bins)
        after = packing.LocalSearch(sizes, numbered, capacity).run()
        assert sorted(i for b in after for i in b) == list(range(len(sizes)))
        assert sum(sum(sizes[i] for i in b) ** 2 for b in after) > before
        assert sorted(sorted(sizes[i] for i in b) for b in after) == sorted(map(sorted, want))


def test_very_many_small_pieces():
    for sizes in ([1] * 100_000, [1, 2, 3] * 5000, [1] * 16_384, [2047, 1] * 2000 + [1500] * 900 + [3] * 3000):
        bins = packing.pack_sizes(sizes)
        assert len(bins) <= len(packing.best_fit(sizes, 2048)) and sorted(i for b in bins for i in b) == list(range(len(sizes)))


def test_pack_many_empty_texts(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("")).alias("text"), F.lit(1).alias("shard"))
    found = packing.pack(docs, VOCABULARY).groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last")).collect()
    assert len(found) == 3 and sum(r["n"] for r in found) == 5000 and all(r["last"] == r["n"] - 1 for r in found)


def test_pack_of_nothing(none):
    assert packing.pack(none, VOCABULARY).count() == 0


# 6


def line_brute(texts, least, long_words=None):
    """(maximal runs, text left) of each text, by the longest match of every line with every earlier place."""
    out, before = [], []
    for t in texts:
        if t is None:
            out.append(([], None))
            continue
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        own, runs, reach = [lines[i] for i in at], [], 0
        for k in range(len(own)):
            n = 0
            for other, stop in [*[(o, len(o)) for o in before], (own, k)]:
                for j in range(stop):
                    m = 0
                    while k + m < len(own) and j + m < len(other) and own[k + m] == other[j + m]:
                        m += 1
                    n = max(n, m)
            if n < least:
                n = int(n > 0 and long_words is not None and len(words(own[k])) >= long_words)
            if n and k + n > reach:
                reach = k + n
                runs.append((at[k], at[reach - 1]))
        before.append(own)
        gone = {i for a, b in runs for i in range(a, b + 1)}
        out.append((runs, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


@pytest.mark.parametrize(("least", "long_words"), [(2, None), (3, None), (2, 3), (5, 2)])
def test_line_dedup(spark, least, long_words):
    rng = np.random.default_rng(least)
    texts = TEXTS + ["\n".join(rng.choice(["p", "q", "r s", "", "t", "u v w"], 12)) for _ in range(12)]
    found = {r["row"]["doc_id"]: r for r in linededup.dedup(documents(spark, texts), least, long_words=long_words).collect()}
    want = line_brute(texts, least, long_words)
    assert [([tuple(x) for x in found[i]["runs"]], found[i]["kept"]) for i in range(len(texts))] == want
    assert [found[i]["n_lines"] for i in range(3)] == [0, 1, 2]


def test_line_dedup_finds_the_longest_runs(spark):
    """Runs of 3 to 50 lines, copied from several places, cut short, nested and put side by side."""
    rng = np.random.default_rng(9)
    source = [f"line {i}" for i in range(120)]
    texts = ["\n".join(source[:70]), "\n".join(source[60:])]
    for i in range(25):
        a, n = int(rng.integers(0, 70)), int(rng.integers(3, 51))
        b, m = int(rng.integers(0, 100)), int(rng.integers(3, 20))
        texts.append("\n".join([f"own {i}", *source[a : a + n], *([f"mid {i}"] if i % 2 else []), *source[b : b + m], "", f"end {i}"]))
    texts += ["\n".join(["same"] * 13), "\n".join(["same"] * 9 + ["x"])]
    docs = documents(spark, texts)
    found = {r["row"]["doc_id"]: r for r in linededup.dedup(docs.unionByName(docs.where("doc_id in (0, 5)"))).collect()}
    want = line_brute(texts, 2)
    assert [([tuple(x) for x in found[i]["runs"]], found[i]["kept"]) for i in range(len(texts))] == want
    assert max(b - a for runs, _ in want for a, b in runs) >= 45


def test_line_dedup_cuts_long_single_lines(spark):
    long, short = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("p", 51), ("q", 50)))
    texts = [f"a\n{long}\nb", long, f"c\n\n{long}\nd", f"e\n{long}\n{short}\nf\n{long}", f"{short}\nf\n{long}\ng", short, f"h\n{long}\nc\n{long}\nd"]
    found = {r["doc_id"]: r["text"] for r in linededup.deduped(documents(spark, texts), long_words=linededup.LONG_WORDS).collect()}
    assert found == {0: texts[0], 2: "c\n\nd", 3: f"e\n{short}\nf", 4: "g", 5: short, 6: "h"}
    plain = {r["doc_id"]: r["text"] for r in linededup.deduped(documents(spark, texts)).collect()}
    assert plain[1] == long and plain[2] == texts[2]


def test_line_dedup_drops_what_is_left_empty(docs, none):
    left = linededup.deduped(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in left.collect()} == set()
    twice = docs.where("doc_id = 9").unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(20).cast("long")))
    assert [r["doc_id"] for r in linededup.deduped(twice).collect()] == [9]
    assert linededup.dedup(none).count() == 0


# 7


def groups_brute(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def near_copies(rng, n, length, changes):
    base = [f"b{i}" for i in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, rng.integers(0, changes + 1)):
            w[at] = f"z{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    sets = jaccard.Sets([t.encode() for t in near_copies(rng, 40, 90, 30)] + [b"one two"], 5)
    tokens = [set(sets.token[a : a + n].tolist()) for a, n in zip(sets.starts, sets.sizes)]
    bits = np.stack(jaccard._bitmaps(sets.token, sets.starts), 1).view(np.uint64)
    for i in range(len(tokens)):
        for j in range(len(tokens)):
            assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(tokens[i] ^ tokens[j])


def test_jaccard_buckets_fold_in_parts():
    rng = np.random.default_rng(8)
    bucket, seen = jaccard.Bucket(), defaultdict(list)
    for _ in range(30):
        low, mark = rng.integers(0, 60, 25).astype("<u4"), rng.integers(0, 4, 25)
        bucket.fold(low, mark)
        if rng.integers(0, 2):
            bucket.close()
        for x, m in zip(low.tolist(), mark.tolist()):
            seen[x].append(m)
    bucket.close()
    assert bucket.low.tolist() == sorted(seen)
    hit, count = bucket.shared(bucket.low)
    assert hit.tolist() == [len(set(seen[x])) > 1 for x in sorted(seen)]
    assert count.tolist() == [len(seen[x]) for x in sorted(seen) if len(set(seen[x])) > 1]


def test_jaccard_packed_bytes_do_not_grow_with_buckets(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"u{rng.integers(0, 10**6)}" for _ in range(124)) for _ in range(200)]
    size = {}
    for buckets in (8, 512):
        packed = jaccard.packed_tokens(documents(spark, texts), buckets)
        binary = [c for c, kind in packed.dtypes if kind == "binary"]
        size[buckets] = packed.agg(F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in binary))).first()[0]
    assert size[512] <= 1.1 * size[8] <= 1.1 * 11 * 200 * 120


def test_jaccard_sample_drops_sets_that_link_with_nothing(spark):
    rng = np.random.default_rng(10)
    texts = near_copies(rng, 60, 100, 9) + [" ".join(f"u{k}_{i}" for i in range(n)) for k, n in enumerate(rng.integers(1, 200, 60))] + ["", None]
    docs = documents(spark, texts)
    members = {r["doc_id"]: (r["n"], r["f"]) for r in jaccard.members_of(docs.select("doc_id", "text")).collect()}
    left = {r["f"] for r in jaccard.may_link(docs, sum(n for n, _ in members.values()), 80).collect()}
    want = groups_brute(texts)
    sizes = Counter(c for _, c in want.values())
    assert {members[i][1] for i, (_, c) in want.items() if sizes[c] > 1} <= left
    assert len(left - {members[i][1] for i in range(60)}) < 10


@pytest.mark.parametrize("held", [1, 1 << 25])
def test_jaccard_bucket_answers(monkeypatch, held):
    """Rows of a bucket in a file or in memory, whole tokens and halves; a set that meets itself alone shares nothing."""
    monkeypatch.setattr(jaccard, "HELD", held)
    docs, low, high = [np.array(x, kind).tobytes() for x, kind in (([0, 0, 2, 2], "<u2"), ([5, 6, 7, 7], "<u4"), ([1, 2, 3, 4], "<u4"))]
    other = [np.array(x, kind).tobytes() for x, kind in (([1], "<u2"), ([6], "<u4"), ([2], "<u4"))]
    for whole in (True, False):
        rows = [(0, 3, b"marks", b"sizes", None, None, None), (0, 3, None, None, docs, low, high if whole else None), (0, 4, None, None, *other[:2], other[2] if whole else None)]
        found = [tuple(r.values()) for b in jaccard._answers(jaccard._batch([r], jaccard.PACKED) for r in rows) for r in b.to_pylist()]
        assert found[0] == (3, b"marks", b"sizes", None, None, None)
        if whole:
            assert [(c, list(np.frombuffer(d, "<u2")), list(np.frombuffer(t, "<u8")), list(np.frombuffer(n, "<u4"))) for c, _, _, d, t, n in found[1:]] == [(3, [0], [2 << 32 | 6], [2]), (4, [1], [2 << 32 | 6], [2])]
        else:
            assert [(c, list(np.frombuffer(d, "<u2")), t, n) for c, _, _, d, t, n in found[1:]] == [(3, [0, 2, 2], None, None)]


def test_jaccard_groups(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + near_copies(rng, 70, 120, 5) + ["common passage of seven words here now " + " ".join(f"u{k}_{i}" for i in range(20)) for k in range(40)] + ["A b C d", "a B c D", "a b c"]
    want = groups_brute(texts)
    rows = jaccard.groups(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert sum(r["stays"] for r in rows if r["n_shingles"]) == len({c for n, c in want.values() if n})


@pytest.mark.parametrize(("small", "heads", "rows"), [(0, 1, 0), (2, 2, 0), (16, 8, 4)])
def test_jaccard_turns(spark, monkeypatch, small, heads, rows):
    """Blocks without a centre, whose parts are joined or never join, with heads taken one, two or more at a time."""
    for name, value in (("SMALL", small), ("HEADS", heads), ("PAIRS_A_ROW", rows)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(4)
    texts = near_copies(rng, 25, 60, 3)
    walk = [f"c{i}" for i in range(80)]
    for i in range(24):  # a chain: neighbours link, ends don't
        texts.append(" ".join(walk))
        walk[3 * i] = f"y{i}"
    for i in range(20):  # alike, but not enough
        texts.append(" ".join(w if (j + i) % 10 else f"d{(j * i) % 7}" for j, w in enumerate(f"e{k}" for k in range(60))))
    found = jaccard.groups(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups_brute(texts)


def test_jaccard_brute_force_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = groups_brute([t for _, t in rows])
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert found == {rows[i][0]: (n, rows[c][0]) for i, (n, c) in want.items()}


def test_one_of_each_with_clashing_names(spark, docs):
    clashing = docs.select("*", *[F.lit(n).alias(n) for n in ("n_shingles", "own_id", "own_hash", "hash", "id", "row", "component", "f")] if "row" not in docs.columns else [])
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns and kept.count() == 9


def test_jaccard_links_rows_without_an_id(spark):
    base = [f"b{i}" for i in range(100)]
    changed = lambda *at: " ".join(f"z{i}" if i in at else w for i, w in enumerate(base))
    texts = [changed(50), changed(), changed(0, 99), " ".join(f"u{i}" for i in range(40))]
    far = changed(20, 50), changed(50, 80)
    for ids, texts, want in (((1, None), texts[:2], {1}), ((1, None, 3), (far[0], texts[0], far[1]), {1}), ((None, None), texts[1:3], {None}), ((4, None), texts[2:], {4, None})):
        rows = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        found = jaccard.groups(rows).collect()
        assert {r["component_id"] for r in found} == want and sum(r["stays"] for r in found) == len(want)
        assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(rows).collect()) == sorted(map(str, want))


def test_one_of_each(docs, none):
    kept = jaccard.one_of_each(docs.unionByName(docs.where("doc_id = 5")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 10]
    assert jaccard.groups(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (7, 7), (-5, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, -5: -5, 300: -5}


# 8


def test_audio(docs, none):
    rows = {r["doc_id"]: r for r in audio.stored_features(audio.store(docs)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = audio.to_wav(payload)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        tensors, spans = audio.tensors_of_clip(bytes(r["tensors"]))
        assert tensors.shape == (r["n_tensors"], 64, 20) and r["n_tensors"] == -(-r["n_frames"] // 64)
        samples = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
        want = log_mel_brute(samples)
        assert len(want) == r["n_frames"] and np.allclose(tensors.reshape(-1, 20)[: len(want)], want, rtol=2e-3, atol=2e-2)
        assert spans[0][0] == 0 and spans[-1][1] == pytest.approx(len(want) * 0.01) and (spans[1:, 0] == spans[:-1, 1]).all()
    assert rows[4]["tensors"] == rows[5]["tensors"] and rows[0]["segments"] == []
    field = pa.ipc.open_stream(bytes(rows[7]["tensors"])).schema.field("tensor").type
    assert isinstance(field, pa.FixedShapeTensorType) and field.shape == [64, 20]
    assert audio.stored_features(audio.store(none)).count() == 0


def log_mel_brute(samples):
    """Zeros put between the samples, the whole filtered and thinned out; frames transformed by the defining sums."""
    t = np.arange(72) - 35.5
    low_pass = np.sinc(t / 8) * np.hanning(74)[1:-1]
    up = np.zeros(3 * len(samples))
    up[::3] = samples
    signal = np.convolve(up, np.concatenate([low_pass * 3 / low_pass.sum(), np.zeros(8)]))[33::8][: -(-len(samples) * 3 // 8)]
    n = 1 + max(0, -(-(len(signal) - 150) // 60))
    signal = np.concatenate([signal, np.zeros((n - 1) * 60 + 150 - len(signal))])
    wave = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(150)) / 256)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(3000), 22) / 2595) - 1)
    bank = np.array([[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for f in np.arange(129) * 6000 / 256] for a, b, c in zip(edges, edges[1:], edges[2:])])
    power = [np.abs(wave @ (signal[60 * i : 60 * i + 150] * np.hanning(150))) ** 2 for i in range(n)]
    return np.log(np.array(power) @ bank.T + 1e-6)


def test_resampling_keeps_a_tone():
    t = np.arange(16_000) / 16_000
    out = audio.resample(np.sin(2 * np.pi * 500 * t).astype(np.float32))
    assert len(out) == 6000
    spectrum = np.abs(np.fft.rfft(out))
    assert spectrum.argmax() == 500 and 0.9 < spectrum.max() / 3000 < 1.1
    high = audio.resample(np.sin(2 * np.pi * 6000 * t).astype(np.float32))
    assert np.abs(high[50:-50]).max() < 0.05


def test_hysteresis():
    energy = np.array([0, 0, 5, 3, 3, 5, 0, 0, 2.6, 0], float)
    assert audio.hysteresis(energy) == [(2, 6)]
    assert audio.hysteresis(np.zeros(4)) == []


# 9


def test_ann_recall_and_rules(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(2000, None, "s"), (2001, [0.0] * 16, "s"), (2002, [float("nan")] * 16, "s"), (2003, [1.0, None] * 8, "s"), (2004, [1.0], "s"), (2005, [], "s"), (2006, [float("inf")] * 16, "s"), (100, x[100].tolist(), "s")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in ann.search(vectors, keep=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    wide = x.astype(np.float64)
    for q, found in got.items():
        exact = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(exact, 10))) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert len(found) == 20 and all(s == pytest.approx(exact[i], abs=1e-9) for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(vectors.where("vec_id < 3")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert ann.search(vectors.limit(0)).count() == 0


def recall(vectors, **options):
    """Of the 20 nearest of each query by brute force, the share that is found, and the number of queries."""
    rows = vectors.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got, hits = defaultdict(list), 0
    for r in ann.search(vectors, **options).collect():
        got[r["query_id"]].append(r["vec_id"])
    for q, found in got.items():
        exact = x @ x[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -exact))] if i != q][:20]
        hits += len(set(found) & set(order))
    assert set(got) == {i for i in ids if i % 20 == 0}
    return hits / (20 * len(got))


def test_ann_recall_over_all_queries(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    assert recall(vectors) >= 0.99
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    monkeypatch.setattr(ann, "CODE_BLOCK", 300)
    assert recall(vectors, keep=200) >= 0.9


def test_ann_norms_help(spark):
    """On a whole table more of the nearest stand on a short list with the stored norms than without."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float32)
    model = ann.train(x)
    codes, norms = model.encode(x)
    assert np.allclose(norms, np.linalg.norm(x, axis=1) / np.linalg.norm(model.decode(codes), axis=1), rtol=1e-3)
    exact, about = x[::5] @ x.T, x[::5] @ model.decode(codes).T
    nearest = lambda scores, n: [set(np.argsort(-row, kind="stable")[:n]) for row in scores]
    found = lambda scores: np.mean([len(a & b) / 20 for a, b in zip(nearest(exact, 20), nearest(scores, 60))])
    assert found(about * norms) > found(about) > 0.8


# 10


def substring_brute(texts, n=13):
    least = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            least.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        out.append((len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring_dedup(spark, none):
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(40)]
    texts = list(TEXTS)
    for _ in range(30):
        a = rng.integers(0, 30)
        own = [f"v{rng.integers(0, 9)}" for _ in range(rng.integers(0, 25))]
        texts.append(" ".join(own + passage[a : a + rng.integers(5, 40)] + own))
    docs = documents(spark, texts)
    found = {r["doc_id"]: (r["n_words"], r["kept"]) for r in substrings.dedup(docs.unionByName(docs.where("doc_id = 8"))).collect()}
    assert [found[i] for i in range(len(texts))] == substring_brute(texts)
    nameless = docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["kept"] for r in substrings.dedup(docs.unionByName(nameless)).where("doc_id is null").collect()] == [" ".join(words(TEXTS[8]))]
    assert substrings.dedup(none).count() == 0


def test_packed_rows_round_trip():
    rng = np.random.default_rng(7)
    doc, place = np.repeat([3, -4, 9], 50), np.tile(np.arange(50), 3) * 70_000
    hashes = rng.integers(0, 2**63, 150, dtype=np.uint64)
    seen = set()
    for b, *raw in substrings.pack(hashes, doc, place, 7):
        ids, starts, prints, places = substrings.unpack(*raw)
        own = np.repeat(ids, np.diff(np.append(starts, len(prints))))
        seen |= {(b, int(d), int(h), int(p)) for d, h, p in zip(own, prints, places)}
    assert seen == {(int((h >> np.uint64(32)) % np.uint64(7)), int(d), int(h & np.uint64(2**32 - 1)), int(p)) for h, d, p in zip(hashes, doc, place)}


def test_word_hashes_tell_structured_words_apart():
    from paperloom.llm.shingles import Words

    word = "a"
    for _ in range(10):  # each other's complement: equal under any polynomial modulo a power of two
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, "x " + word, "abcdefgh", "abcdefg", "abcdefghi", "abcdefgh\0", "", "a" * 100_001]
    hashes = Words([t.encode() for t in texts]).hashes.tolist()
    assert hashes[0] == hashes[3] and len(set(hashes)) == len(hashes) - 1
    alone = [Words([t.encode()]).hashes.tolist() for t in texts]
    assert [h for one in alone for h in one] == hashes


def test_log_mel_in_blocks(monkeypatch):
    signal = np.random.default_rng(4).normal(size=6000).astype(np.float32)
    whole = audio.log_mel(signal)
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, audio.log_mel(signal)))


def test_inner_names_may_clash(spark, docs):
    odd = docs.selectExpr("*", *[f"1 as {c}" for c in ("hash", "place", "least", "later", "copies", "score", "clauses", "id", "label", "word", "n")])
    plain, same = (sorted(map(tuple, substrings.dedup(d).select("doc_id", "n_words", "kept").collect()), key=str) for d in (docs, odd))
    assert plain == same
    grader = toxicity.Grader(toxicity.Lexicon({"same$": 1.0}), toxicity.ordered(toxicity.PRIOR))
    plain, same = (sorted(map(tuple, toxicity.score(d, grader).select("doc_id", "score", "predicted").collect())) for d in (docs, odd))
    assert plain == same and any(r[2] for r in plain)
    assert sorted(toxicity.clean(odd, grader).columns) == sorted(odd.columns)
