"""Suffix-array dedup against brute force, and the family's own arrays and levels."""

import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import suffixes

SIZE = suffixes.LENGTH


def brute(rows):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - SIZE + 1):
                first[b[p : p + SIZE]] = min(first.get(b[p : p + SIZE], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - SIZE + 1):
                if first[b[p : p + SIZE]] < i:
                    gone[p : p + SIZE] = [True] * SIZE
        starts = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), starts, bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(df, **options):
    rows = suffixes.dedup(df, **options).collect()
    return sorted([(r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["removed"]), len(r["removed"]), bytes(r["kept"])) for r in rows], key=repr)


def made_up(seed):
    deal = random.Random(seed)
    words = ["alpha", "beta", "été", "gamma", "x", "delta ", "\n", "ababab"]
    passages = [" ".join(deal.choices(words, k=deal.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [deal.choice(passages)[deal.randint(0, 20) :] if deal.random() < 0.5 else " ".join(deal.choices(words, k=deal.randint(0, 40))) for _ in range(deal.randint(0, 5))]
        rows.append((deal.choice([i, i, i, i // 2, None, -i]), "".join(parts)))
    return rows + [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 60), (504, "a" * 49), (505, "a" * 50)]


def test_spans_equal_brute_force(spark):
    rows = made_up(7)
    # columns named like inner ones
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, mark string, shard int").repartition(3)
    for options in ({"batches": 1}, {"batches": 5, "frequent": 0}):
        assert found(df, **options) == brute(rows)
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_very_long_texts_are_cut_in_slices(spark):
    deal = np.random.default_rng(3)
    long = "".join(map(chr, deal.integers(97, 123, suffixes.SLICE * 2 + 999)))
    edge = long[suffixes.SLICE - 60 : suffixes.SLICE + 60]
    df = spark.createDataFrame([(1, edge), (2, long), (3, long[5:])], "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in suffixes.dedup(df).collect()}
    assert got[1] == [] and [tuple(s) for s in got[2]] == [(suffixes.SLICE - 60, suffixes.SLICE + 60)]
    assert [tuple(s) for s in got[3]] == [(0, len(long) - 5)]


def test_suffix_arrays_are_in_the_order_of_bytes():
    raw = np.random.default_rng(5).integers(0, 3, 4000).astype(np.uint8)
    raw[1000:1300] = raw[:300]
    windows = suffixes.windows_at(raw, np.arange(len(raw) - SIZE + 1))
    order, firsts = suffixes.suffix_array(windows)
    plain = [raw[i : i + SIZE].tobytes() for i in range(len(windows))]
    assert [plain[i] for i in order] == sorted(plain) and len(firsts) == len(set(plain))


def test_levels_merge_geometrically(spark):
    text = "".join(map(chr, np.random.default_rng(11).integers(97, 123, 900)))
    family, ranks = suffixes.Family(3), []
    for k in range(5):  # any two batches share 300 bytes
        own = text[100 * k : 100 * k + 400]
        rows = spark.createDataFrame([(2 * k, own), (2 * k + 1, own)], "doc_id long, text string").withColumn("text_hash", F.hash("text"))
        found_ = family.add(suffixes.segments_of(rows, suffixes.copies_of(rows).limit(0), 800).drop("batch")).where(F.col("kind") == suffixes.NEW).collect()
        seen = sum(r["stop"] - r["start"] for x in found_ for r in x["repeats"] if r["least"] == suffixes.ANY_ID)
        assert seen == (251 if k else 0)  # windows of the 300 bytes that the batch before had
        ranks.append([r for r, _ in family.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0]]
    held = family.levels[0][1].where(F.col("kind") == suffixes.LEVEL).collect()
    stored = [w for r in held for w in suffixes.windows_at(np.frombuffer(r["bytes"], np.uint8), np.frombuffer(r["places"], "<i4"))]
    assert sorted(stored) == sorted({text[i : i + SIZE].encode() for i in range(700 - SIZE + 1)})
    for r in held:
        own = suffixes.windows_at(np.frombuffer(r["bytes"], np.uint8), np.frombuffer(r["places"], "<i4")).tolist()
        assert own == sorted(own)
