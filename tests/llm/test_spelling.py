"""Spelling variants against brute force, and the automata's own properties."""

import random
import zlib
from collections import Counter

import pytest

from paperloom.llm import spelling

LETTERS = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, noise=True):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in LETTERS:
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if noise and doc_id is not None and h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += 1
                run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    forms, out = {}, []
    near_of = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, others in near_of.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, counts[w], len(near_of[w]), forms[w], counts.get(forms[w]), root))
    return sorted(out, key=str)


def grouped(df, **options):
    return sorted(map(tuple, spelling.variants(df, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


def made_up(seed, size=400):
    deal = random.Random(seed)
    stems = ["".join(deal.choices("aabcéß", k=deal.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(size):
        own = []
        for _ in range(deal.randint(0, 40)):
            w = list(deal.choice(stems))
            if deal.random() < 0.3:
                k = deal.randrange(len(w))
                w[k : k + deal.randint(0, 1)] = deal.choices("abcÉé", k=deal.randint(0, 1))
            own.append("".join(w).upper() if deal.random() < 0.05 else "".join(w))
        rows.append((i, " 1,".join(own)))
    return rows + [(None, "lonely lonely lonely lonelx lonelx lonelx"), (900, None), (901, ""), (902, " ".join(["a" * 3000] * 3)), (903, "kettena " * 3 + "ketten " * 12 + "kette " * 60), (902, "naïve naïve naïve")]


@pytest.fixture(scope="module")
def rows():
    return made_up(5)


def test_groups_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "word", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    got = grouped(df, noise=True)
    assert got == brute(rows) and max(r[2] for r in got) > 5 and any(r[3] and r[5] != r[3] for r in got)
    assert grouped(df) == brute(rows, noise=False)
    assert spelling.variants(df.limit(0)).count() == 0


def test_sliced_halves_give_the_same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = spelling.word_counts(df, "doc_id", "text", True).cache()
    rows_of = lambda **o: sorted(map(tuple, spelling.near_words(counts, **o).collect()))
    assert rows_of(slice_size=2, bucket_size=10) == rows_of()


def test_noise_deletes_the_code_point_that_the_checksum_names():
    doc, run = next((d, "spelling") for d in range(10_000) if zlib.crc32(f"{d}:spelling".encode()) % 97 == 0)
    at = zlib.crc32(f"{doc}:{run}".encode()) % len(run)
    assert spelling.word_of(doc, run) == run[:at] + run[at + 1 :] and spelling.word_of(None, run) == run


def test_automata_are_minimal_and_number_their_words():
    deal = random.Random(2)
    words = sorted({"".join(deal.choices("abcé", k=deal.randint(1, 7))) for _ in range(700)})
    own = spelling.Automaton(words)
    following: dict[str, set] = {"": set(words)}
    for w in words:
        for i in range(len(w) + 1):
            following.setdefault(w[:i], set()).add(w[i:])
    assert len(own.final) == len({frozenset(v) for k, v in following.items() if k or v})
    for number, w in enumerate(words):
        state, total = own.start, 0
        for c in w:
            (hit,), at = own.step(spelling.np.array([state]), spelling.np.array([ord(c)]))
            assert hit
            state, total = own.to[at[0]], total + int(own.skips[at[0]])
        assert own.final[state] and total == number
    search, number = own.one_error(["abc", "zz", words[5]], [0, 0, 0])
    assert {words[n] for s, n in zip(search, number) if s == 0} == {w for w in words if near("abc", w)}
    assert 1 not in search
