"""Spelling variants grouped by forward and backward minimal acyclic automata.

Words are maximal runs of letters, A-Z lower-cased, counted over all texts. Two words are near if one code point is
inserted, deleted or replaced between them. A word is looked for with its first half exact in an automaton of words
read forwards, and with its second half exact in one of words read backwards: one of both halves is free of the error.
After the exact half, the other one is completed with one error. What the backward search finds with the first half equal as well
is left to the forward one, so that each near word counts once.

Words are filed by their halves: one of length n under the prefixes (suffixes) that words of length n - 1, n and n + 1
search with, and each searches under its own. Halves are dealt to buckets; a half with more than ``SLICE`` words is dealt
to slices that each search of it visits, so a task's dictionary stays bounded. A task builds the minimal automaton of its
bucket's words, whose transitions carry how many words go before: the sum along a path is the word's number (a minimal perfect
hash) and leads to its count. All searches of a block walk together as arrays; a task returns one row a search.

A word's form is its most frequent near word, if that is at least ``RATIO`` times as frequent; roots follow forms by
doubling, which takes few rounds as counts double with each form.

Defined cases: null or empty text has no words; ties of counts go to the smaller word; rows repeated count each; a null
doc_id leaves its runs as they are; an empty table gives an empty result; runs of any length are words; names of further
columns can't clash, as only id and text are read. Equal states are found by 64-bit hashes of what follows them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import LOWER, UPPER, discard, written
from paperloom.llm.shingles import mix

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: A run whose checksum with its document this divides loses one code point.
NOISE = 97
#: Words of a slice of one half at most on average, words of a bucket, searches walked together, and words held before their counts are passed on.
SLICE, BUCKET, BLOCK, HELD = 50_000, 50_000, 20_000, 200_000
FORWARD, BACKWARD = 0, 1
NEAR = "word string, near long, best_n long, best string"
_TABLE = str.maketrans(UPPER, LOWER)
_HIGH = np.uint64(21)  # code points need 21 bits


def word_of(doc_id: int | None, run: str) -> str:
    """The run, or what is left of it after the noise of its document."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if doc_id is None or h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, noise: bool) -> DataFrame:
    """(word, n) of words of enough length and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                runs = Counter(LETTERS.findall((text.as_py() or "").translate(_TABLE)))
                if noise and doc_id is not None:
                    base = zlib.crc32(f"{doc_id}:".encode())
                    for w in [w for w in runs if zlib.crc32(w.encode(), base) % NOISE == 0]:
                        n = runs.pop(w)
                        held[word_of(doc_id, w)] += n
                held.update(runs)
                if len(held) > HELD:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    counted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of different ``words`` in ascending order, and their numbers in it."""

    def __init__(self, words: list[str]):
        parent, symbol, final, depth, path, before = [0], [0], [not len(words[0]) if words else False], [0], [0], ""
        for word in words:
            k, most = 0, min(len(word), len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del path[k + 1 :]
            for i in range(k, len(word)):
                parent.append(path[-1])
                symbol.append(ord(word[i]))
                final.append(False)
                depth.append(i + 1)
                path.append(len(parent) - 1)
            final[path[-1]], before = True, word
        parent, symbol, final, depth = np.array(parent), np.array(symbol, np.uint64), np.array(final), np.array(depth)
        height = np.zeros(len(parent), np.int64)
        by_depth = np.argsort(depth, kind="stable")
        for nodes in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[:0:-1]:
            np.maximum.at(height, parent[nodes], height[nodes] + 1)
        # States are made from the leaves up: nodes with equal finality and equal transitions are one.
        after, state, words_below = np.zeros(len(parent), np.uint64), np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        chosen, made = [], 0
        by_height = np.argsort(height, kind="stable")
        for nodes in np.split(by_height, np.flatnonzero(np.diff(height[by_height])) + 1):
            _, first, same = np.unique(after[nodes] + final[nodes].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
            state[nodes] = made + same
            chosen.append(nodes[first])
            made += len(first)
            words_below[nodes] += final[nodes]
            below = nodes[nodes > 0]
            np.add.at(after, parent[below], mix(state[below].astype(np.uint64) << _HIGH | symbol[below], 50))
            np.add.at(words_below, parent[below], words_below[below])
        chosen = np.concatenate(chosen)
        keeps = np.zeros(len(parent), bool)
        keeps[chosen] = True
        edges = np.arange(1, len(parent))
        edges = edges[keeps[parent[edges]]]
        self.key = state[parent[edges]].astype(np.uint64) << _HIGH | symbol[edges]
        order = np.argsort(self.key)
        self.key, edges = self.key[order], edges[order]
        self.to, self.symbol, source = state[edges], symbol[edges].astype(np.int64), state[parent[edges]]
        self.final = final[chosen]
        self.start = state[0]
        # Words before a transition: the state's own, if it ends one, and those below its smaller transitions.
        sums = np.concatenate([[0], np.cumsum(words_below[edges])])
        self.first = np.searchsorted(source, np.arange(made + 1))
        self.skips = sums[:-1] - sums[self.first[source]] + self.final[source]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a transition, and which one it is."""
        if not len(self.key):
            return np.zeros(len(state), bool), np.zeros(0, np.int64)
        key = state.astype(np.uint64) << _HIGH | symbol.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return hit, at[hit]

    def one_error(self, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(search, word number) of all words that begin with the exact part of a search and go on with one error; in order, once each."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        codes, begin, exact = np.append(codes, 0), np.cumsum(length) - length, np.array(exact, np.int64)
        search = np.arange(len(words))
        state, number, place = np.full(len(words), self.start), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def ahead(search, state, number, place):
            """One exact step of all of them."""
            hit, at = self.step(state, codes[begin[search] + place])
            return search[hit], self.to[at], number[hit] + self.skips[at], place[hit] + 1

        pool = [np.zeros(0, np.int64)] * 4
        least = 1 << 16
        while len(search) or len(pool[0]):
            # Searches behind their error go on exactly, those before it get one here; all take one step a turn.
            done = pool[3] == length[pool[0]]
            ends = done & self.final[pool[1]]
            found.append((pool[0][ends], pool[2][ends]))
            pool = ahead(*(x[~done] for x in pool))
            ready = place >= exact[search]
            s, t, n, p = (x[ready] for x in (search, state, number, place))
            inside = p < length[s]
            new = [(s[inside], t[inside], n[inside], p[inside] + 1)]  # deleted
            fan = self.first[t + 1] - self.first[t]
            at = np.repeat(self.first[t], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            s, n, p = np.repeat(s, fan), np.repeat(n, fan) + self.skips[at], np.repeat(p, fan)
            new.append((s, self.to[at], n, p))  # inserted
            other = (p < length[s]) & (codes[begin[s] + p] != self.symbol[at])
            new.append((s[other], self.to[at[other]], n[other], p[other] + 1))  # replaced
            pool = [np.concatenate(x) for x in zip(pool, *new)]
            if len(pool[0]) > least:  # errors at several places of a repetitive word lead to the same
                order = np.lexsort((pool[3], pool[2], pool[1], pool[0]))
                pool = [x[order] for x in pool]
                differs = np.logical_or.reduce([x[1:] != x[:-1] for x in pool])
                pool = [x[np.append(True, differs)] for x in pool]
                least = max(least, 2 * len(pool[0]))
            inside = place < length[search]
            search, state, number, place = ahead(*(x[inside] for x in (search, state, number, place)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        search, number = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((number, search))
        search, number = search[order], number[order]
        new = np.concatenate([[True], (search[1:] != search[:-1]) | (number[1:] != number[:-1])])[: len(search)]
        return search[new], number[new]


def half(length):
    """Code points of a word's first half."""
    return length // 2


def near_in(words: dict[str, int], searches: list[tuple[str, int, int]], direction: int) -> Iterator[tuple[str, int, int, str]]:
    """NEAR rows of ``searches`` (word, slice, slices) among ``words``, in one direction; those without a near word are left out.

    A bucket may hold further slices of the same half; a visit takes its own slice's words alone.
    """
    turn = (lambda w: w[::-1]) if direction == BACKWARD else (lambda w: w)
    filed = sorted(map(turn, words))
    automaton, plain = Automaton(filed), list(map(turn, filed))
    for a in range(0, len(searches), BLOCK):
        visits = searches[a : a + BLOCK]
        own = [w for w, _, _ in visits]
        exact = [half(len(w)) if direction == FORWARD else len(w) - half(len(w)) for w in own]
        best: dict[int, list] = {}
        for s, k in zip(*[x.tolist() for x in automaton.one_error(list(map(turn, own)), exact)]):
            (word, part, parts), other = visits[s], plain[k]
            if parts > 1 and zlib.crc32(other.encode()) % parts != part:
                continue
            if direction == FORWARD or not other.startswith(word[: half(len(word))]):
                rank = (-words[other], other)
                held = best.setdefault(s, [0, rank])
                held[0] += 1
                held[1] = min(held[1], rank)
        for s, (n, (less, other)) in best.items():
            yield own[s], n, -less, other


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NEAR rows of (bucket, direction, search, word, n, slice, slices), bucket by bucket and direction by direction."""

    def rows(words: dict, searches: list, direction: int) -> Iterator[pa.RecordBatch]:
        out = list(near_in(words, searches, direction)) if words and searches else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "near", "best_n", "best"])

    key, words, searches = None, {}, []
    for batch in batches:
        for bucket, direction, search, word, n, part, parts in zip(*[c.to_pylist() for c in batch.columns]):
            if (bucket, direction) != key:
                if key:
                    yield from rows(words, searches, key[1])
                key, words, searches = (bucket, direction), {}, []
            if search:
                searches.append((word, part, parts))
            else:
                words[word] = n
    if key:
        yield from rows(words, searches, key[1])


def near_words(counts: DataFrame, slice_size: int = SLICE, bucket_size: int = BUCKET) -> DataFrame:
    """(word, n_near, form, form_n) of the words of (word, n) that have a near one; form is the most frequent near word."""
    n = F.length("word")
    prefix = lambda k: F.struct(F.lit(FORWARD).alias("direction"), F.substring("word", F.lit(1), k).alias("half"))
    suffix = lambda k: F.struct(F.lit(BACKWARD).alias("direction"), F.substring("word", -k, k).alias("half"))
    lengths = [F.floor((n + d) / 2).cast("int") for d in (-1, 0, 1)]
    tails = [(n + d - F.floor((n + d) / 2)).cast("int") for d in (-1, 0, 1)]
    places = F.array_distinct(F.array(*map(prefix, lengths), *map(suffix, tails)))
    filed = counts.select("word", "n", F.explode(places).alias("at")).select("at.direction", "at.half", F.lit(False).alias("search"), "word", "n")
    sought = counts.select("word", "n", F.explode(F.array(prefix(lengths[1]), suffix(tails[1]))).alias("at")).select("at.direction", "at.half", F.lit(True).alias("search"), "word", "n")
    held = filed.groupBy("direction", "half").agg(F.count(F.lit(1)).alias("held"))
    large = held.where(F.col("held") > slice_size).withColumn("slices", F.ceil(F.col("held") / slice_size).cast("int")).drop("held")
    rows = filed.unionByName(sought).join(large.hint("merge"), ["direction", "half"], "left")
    slices = F.coalesce("slices", F.lit(1))
    visits = F.when(F.col("search"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array((F.crc32(F.col("word").cast("binary")) % slices).cast("int")))
    total = counts.count()
    buckets = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * total // bucket_size))
    dealt = rows.withColumn("slice", F.explode(visits)).select(F.pmod(F.xxhash64("direction", "half", "slice"), F.lit(buckets)).cast("int").alias("bucket"), "direction", "search", "word", "n", "slice", slices.alias("slices"))
    found = dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "direction").mapInArrow(_searched, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), written, of (word, form): the end of each chain, by doubling."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ends = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(ends, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(now)
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        now = moved


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = RATIO, noise: bool = False) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word; ``noise`` deletes code points as a test of the grouping."""
    counts = written(word_counts(docs, id_col, text_col, noise))
    near = near_words(counts)
    large: Column = F.col("form_n") >= F.lit(ratio) * F.col("n")
    every = written(counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("form")).alias("form"), F.when(large, F.col("form_n")).alias("form_n")))
    discard(counts)
    chains = roots(every.where("form is not null"))
    return every.join(chains, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
