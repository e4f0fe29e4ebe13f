"""Variational topic models over the whole vocabulary, cut into blocks of documents and of terms.

Documents are dealt to groups and terms to blocks. A group's task holds its documents' topic weights and the rows of the
terms that stand in it, never topics x vocabulary; a block's task adds up what the groups say about its terms. Both meet once a
round: groups take the term rows, settle their documents and pass on expected counts; blocks sum these and send each group
the rows it needs. What travels is topics x the terms of each group, of ``WAVE`` groups at a time, and what is written is topics x
terms and documents; both are deleted as soon as the next is there. The driver sees a number a topic and block.

A round is one of batch variational Bayes for LDA, with ``steps`` updates of each document's weights, which are
kept from round to round. The start is drawn from a term's own hash, and sums run in a fixed order: a fit is repeatable for a given
number of groups and blocks. A fit of further documents takes the term weights of an earlier one as its prior, so that batches
of a stream add up to one model.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import CLEANED, discard, kept

#: Bytes of a group's or a block's matrix on average.
BYTES = 16 << 20
#: Groups whose rows travel at once, which bounds the disk that a round takes.
WAVE = 64
#: Cells of the documents that are settled together: their rows stay in a processor's cache.
CELLS_AT_ONCE = 8192
CELLS, GAMMA, ROWS, SUMS, PRIOR = 0, 1, 2, 3, 4
STATE = "kind int, group int, block int, ids binary, others binary, values binary"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def _corrections(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x + 6, and what its logarithm is above the digamma function of x, without branches: six steps up, then the series."""
    y, z = x * (x + 5), x + 6
    e = 1 / z
    f = e * e
    series = 0.5 * e + f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    return z, series + (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6))


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for positive numbers."""
    z, above = _corrections(np.array(x, float))
    return np.log(z) - above


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """The exponential of the digamma function of the rows of ``x``, some at a time so that they stay in the cache."""
    x, size = np.asarray(x, float), max(1, 8192 // max(1, x.shape[-1]))
    out = np.empty_like(x)
    for at in range(0, len(x), size):
        z, above = _corrections(x[at : at + size])
        np.multiply(z, np.exp(-above), out=out[at : at + size])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for positive numbers."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        out[low] -= np.log(x[low])
        x[low] += 1
    f = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def settle(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, gamma: np.ndarray, rows: np.ndarray, alpha: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """New topic weights of documents, and expected counts of terms, from cells in the order of documents.

    ``rows`` are the exponentials of the expected logarithms of the terms' chances.
    """
    return settle_parts(doc, term, weight, gamma, rows, alpha, steps, CELLS_AT_ONCE)


def settle_parts(doc: np.ndarray, term: np.ndarray, weight: np.ndarray, gamma: np.ndarray, rows: np.ndarray, alpha: float, steps: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`settle` over runs of whole documents of at most ``cells`` cells, or of one document.

    A run's rows are taken once for all steps; products are made document by document, the rest for all documents of the run.
    """
    k, out = rows.shape[1], np.full_like(gamma, alpha)
    shares, ratios, term = np.zeros_like(gamma), np.empty(len(doc)), term.astype(np.intp)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(starts[1:], len(doc))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + cells, "right")))
        first, last = starts[i], ends[j - 1]
        own, docs, weights, ratio = rows[term[first:last]], doc[starts[i:j]], weight[first:last], ratios[first:last]
        found, sums, now = np.empty(last - first), np.empty((j - i, k)), gamma[docs]
        cut = [slice(a, b) for a, b in zip((starts[i:j] - first).tolist(), (ends[i:j] - first).tolist())]
        owns, founds, each = [own[c] for c in cut], [found[c] for c in cut], [ratio[c] for c in cut]
        for step in range(steps + 1):
            share = exp_digamma(now) / exp_digamma(now.sum(axis=1, keepdims=True))
            for a, b, c in zip(owns, share, founds):
                np.dot(a, b, out=c)
            np.divide(weights, np.maximum(found, 1e-100, out=found), out=ratio)
            if step < steps:
                for a, b, c in zip(each, owns, sums):
                    np.dot(a, b, out=c)
                now = alpha + share * sums
        out[docs], shares[docs] = now, share
        i = j
    counts, doc = np.empty((k, len(rows))), doc.astype(np.intp)
    for topic, share in enumerate(np.ascontiguousarray(shares.T)):
        counts[topic] = np.bincount(term, share[doc] * ratios, len(rows))
    return out, np.multiply(counts.T, rows, order="C")


def start_of(keys: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The first weights of terms, near 1, from hashes of their keys."""
    x = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return 0.85 + 0.3 * ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def _matrix(raw: pa.Buffer, k: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, k)


def _binary(raw: np.ndarray | pa.Buffer | None) -> pa.Array:
    """An array of one value, which isn't copied."""
    if raw is None:
        return pa.nulls(1, pa.binary())
    raw = pa.py_buffer(raw if isinstance(raw, pa.Buffer) else np.ascontiguousarray(raw))
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, raw.size], np.int32)), raw])


def _row(kind: int, group: int, block: int, *raw: np.ndarray | pa.Buffer | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (kind, group, block)], *map(_binary, raw)], NAMES)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of three numbers and three buffers, or nulls; buffers are views of their batch."""
    for batch in batches:
        *numbers, ids, others, values = batch.columns
        for at, row in enumerate(zip(*[c.to_pylist() for c in numbers])):
            yield *row, *[c[at].as_buffer() if c[at].is_valid else None for c in (ids, others, values)]


def layout(cells: DataFrame, id_col: str, groups: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(id, group, doc) of documents, and CELLS rows of (id, term, weight), both written; a term goes by its hash, which gives its block too.

    A CELLS row holds all of a group: documents, places in the group's own list of terms, weights; the list goes with it, a row a block.
    """
    group = F.pmod(F.xxhash64(id_col), F.lit(groups)).cast("int").alias("group")
    docs = cells.select(id_col, group).distinct()
    docs = kept(docs.withColumn("doc", F.row_number().over(Window.partitionBy("group").orderBy(id_col)) - 1))
    placed = cells.select(group, F.col(id_col).alias("id"), F.xxhash64("term").alias("key"), F.col("weight").cast("double").alias("weight"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [batch for batch in batches if batch.num_rows]
        every = pa.Table.from_batches(found).combine_chunks() if found else None
        for number in pc.unique(every["group"]).to_pylist() if found else ():
            own = every.filter(pc.equal(every["group"], number)).combine_chunks()
            coded = own["id"].chunk(0).dictionary_encode()
            doc = np.argsort(pc.array_sort_indices(coded.dictionary).to_numpy())[coded.indices.to_numpy()]
            keys, term = np.unique(own["key"].to_numpy(), return_inverse=True)
            of = np.mod(keys, blocks)  # the order of a group's list is by block, then by key
            by_block = np.argsort(of, kind="stable")
            place = np.argsort(by_block)[term]
            order = np.lexsort((place, doc))
            yield _row(CELLS, number, -1, doc[order].astype("<i4"), place[order].astype("<i4"), own["weight"].to_numpy()[order].astype("<f8"))
            keys, of = keys[by_block], of[by_block]
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(of)) + 1):
                yield _row(ROWS, number, int(of[part[0]]), keys[part].astype("<i8"), None, None)

    return docs, kept(placed.repartitionById(groups, "group").mapInArrow(pack, STATE), **CLEANED)


def fit(cells: DataFrame, k: int, rounds: int = 30, id_col: str = "doc_id", steps: int = 8, alpha: float | None = None, eta: float | None = None, groups: int | None = None, blocks: int | None = None, seed: int = 1, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Document topics (id, topics) and term topics (term, weights) of ``cells`` (id, term, weight), written.

    ``topics`` add up to 1; ``weights`` are a term's variational weights, one a topic. Documents without a cell have no row.
    ``prior`` are the term topics of an earlier fit with as many topics: its counts stay in the result, its terms too.
    """
    spark = cells.sparkSession
    alpha, eta = alpha or 1 / k, eta or 1 / k
    cells = kept(cells.where((F.col("weight") > 0) & F.col("term").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "term", "weight"), **CLEANED)
    terms = kept(cells.select("term").distinct().withColumn("key", F.xxhash64("term")), **CLEANED)
    n, v, d = cells.count(), terms.count(), cells.select(id_col).distinct().count()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # as more groups share more terms
    groups = groups or max(min(least, d), -(-n * k * 8 // (32 * BYTES)), 1)
    blocks = blocks or max(min(least, v), -(-v * k * 8 // BYTES), -(-n * k * 8 // (16 * BYTES)), 1)
    docs, fixed = layout(cells, id_col, groups, blocks)
    discard(cells)

    def by_group(totals: list[float]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, dict] = {}
            for kind, group, block, ids, others, values in _rows_of(batches):
                own = held.setdefault(group, {"rows": {}, "keys": {}})
                if kind == CELLS:
                    own["cells"] = np.frombuffer(ids, "<i4"), np.frombuffer(others, "<i4"), np.frombuffer(values, "<f8")
                elif kind == GAMMA:
                    own["gamma"] = _matrix(values, k)
                else:
                    own["keys"][block], own["rows"][block] = ids, _matrix(values, k)
            for group, own in held.items():
                doc, term, weight = own["cells"]
                order = sorted(own["keys"])
                gamma = own.get("gamma", np.ones((int(doc.max()) + 1, k)))
                chances = np.vstack([own["rows"].pop(b) for b in order])
                chances /= exp_digamma(np.array([totals]))
                gamma, counts = settle(doc, term, weight, gamma, chances, alpha, steps)
                counts[counts < eta * 2.0**-54 / groups] = 0  # all groups' together stay below the last place of a weight, which is eta at least; zeros pack well
                yield _row(GAMMA, group, group % blocks, None, None, gamma)
                at = 0
                for b in order:
                    n = len(own["keys"][b]) // 8
                    yield _row(SUMS, group, b, own["keys"][b], None, counts[at : at + n])
                    at += n

        return run

    def by_block(whole: bool):
        """Sums of what groups say, if ``whole`` on top of the prior; with lists of terms alone, the start."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list] = {}
            known: dict[int, tuple] = {}
            for kind, group, block, ids, _, values in _rows_of(batches):
                if kind == GAMMA:
                    yield _row(GAMMA, group, block, None, None, values)
                elif kind == PRIOR:
                    known[block] = np.frombuffer(ids, "<i8"), _matrix(values, k)
                else:
                    parts.setdefault(block, []).append((group, np.frombuffer(ids, "<i8"), None if values is None else _matrix(values, k)))
            for block, said in parts.items():
                said.sort(key=lambda p: p[0])
                keys = np.unique(np.concatenate([ids for _, ids, _ in said]))
                base = np.full((len(keys), k), eta if whole else 0.0)
                old = np.zeros(len(keys), bool)
                if block in known and len(known[block][0]):
                    ids, rows = known[block]
                    at = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
                    old = ids[at] == keys
                    base[old] = rows[at[old]]
                if said[0][2] is None:
                    sums = np.where(old[:, None], base, start_of(keys, k, seed))
                else:
                    sums = base
                    for _, ids, counts in said:  # a group names a term once
                        sums[np.searchsorted(keys, ids)] += counts
                yield _row(SUMS, said[0][0], block, keys, sums.sum(axis=0), sums)

        return run

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each list of terms, from a block's sums, not yet over the topics' totals."""
        lists: dict[int, list] = {}
        sums: dict[int, tuple] = {}
        for kind, group, block, ids, _, values in _rows_of(batches):
            if kind == SUMS:
                sums[block] = np.frombuffer(ids, "<i8"), _matrix(values, k)
            else:
                lists.setdefault(block, []).append((group, np.frombuffer(ids, "<i8")))
        for block, wanted in lists.items():
            keys, rows = sums[block]
            rows = exp_digamma(rows)
            for group, ids in wanted:
                yield _row(ROWS, group, block, ids, None, rows[np.searchsorted(keys, ids)])

    priors, others = fixed.limit(0), np.zeros(k)
    if prior is not None:

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            return pd.DataFrame([(PRIOR, -1, int(pdf["block"].iloc[0]), pdf["key"].to_numpy("<i8").tobytes(), None, np.vstack(pdf["weights"]).astype("<f8").tobytes())], columns=NAMES)

        priors = kept(terms.join(prior, "term").select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "key", "weights").groupBy("block").applyInPandas(pack, STATE))
        unseen = kept(prior.join(terms.select("term"), "term", "left_anti"))
        others = np.array(totals(unseen) or np.zeros(k))
    lists, state = fixed.where(F.col("kind") == ROWS), None
    for turn in range(rounds + 1):
        before, said = state, []
        for start in range(0, groups if turn else 0, WAVE):
            wave = F.col("group").between(start, start + WAVE - 1)
            rows = lists.where(wave).unionByName(before.where(F.col("kind") == SUMS)).repartitionById(blocks, "block").mapInArrow(to_groups, STATE)
            own = fixed.where((F.col("kind") == CELLS) & wave).unionByName(before.where((F.col("kind") == GAMMA) & wave)).unionByName(rows)
            counts = own.repartitionById(groups, "group").mapInArrow(by_group(total), STATE)
            if groups > WAVE:
                counts = kept(counts.repartitionById(blocks, "block").mapInArrow(by_block(False), STATE), **CLEANED)
            said.append(counts)
        moving = reduce(DataFrame.unionByName, said) if turn else lists
        state = kept(moving.unionByName(priors).repartitionById(blocks, "block").mapInArrow(by_block(True), STATE), **CLEANED)
        discard(*(said if groups > WAVE else []), *([before] if turn else []))
        sums = [np.frombuffer(r["others"], "<f8") for r in state.where(F.col("kind") == SUMS).select("block", "others").orderBy("block").collect()]  # a row a block
        total = np.sum([others, *sums], axis=0).tolist()

    def arrays(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, k, dtype=np.int32), pa.array(rows.ravel()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group, _, _, _, values in _rows_of(batches):
            gamma = _matrix(values, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gamma), group, np.int32)), pa.array(np.arange(len(gamma), dtype=np.int32)), arrays(gamma / gamma.sum(axis=1)[:, None])], ["group", "doc", "topics"])

    def weights_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, ids, _, values in _rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), arrays(_matrix(values, k))], ["key", "weights"])

    of_docs = state.where(F.col("kind") == GAMMA).mapInArrow(documents, "group int, doc int, topics array<double>")
    of_terms = state.where(F.col("kind") == SUMS).mapInArrow(weights_of, "key long, weights array<double>")
    described = terms.join(of_terms, "key").select("term", "weights")
    found = kept(docs.join(of_docs, ["group", "doc"]).select(id_col, "topics"), **CLEANED), kept(described if prior is None else described.unionByName(unseen), **CLEANED)
    discard(fixed, state, docs, terms, *([priors, unseen] if prior is not None else []))
    return found


def totals(term_topics: DataFrame) -> list[float]:
    """The sum of the terms' weights of each topic: one number a topic."""
    each = term_topics.select(F.posexplode("weights").alias("topic", "w")).groupBy("topic").agg(F.sum("w").alias("total"))
    return [r["total"] for r in each.orderBy("topic").collect()]


def infer(cells: DataFrame, term_topics: DataFrame, id_col: str = "doc_id", steps: int = 20, alpha: float | None = None) -> DataFrame:
    """(id, topics) of new documents' ``cells`` (id, term, weight); a document without a known term has no row."""
    sums = totals(term_topics)
    k = len(sums)

    @F.pandas_udf("array<double>")
    def topics(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for weights, rows in batches:
            yield pd.Series([_settled(w, r) for w, r in zip(weights, rows)])

    def _settled(weight, rows) -> list[float]:
        chances = np.exp(digamma(np.vstack(rows)) - digamma(np.array(sums)))
        gamma, _ = settle(np.zeros(len(weight), int), np.arange(len(weight)), np.array(weight, float), np.ones((1, k)), chances, alpha or 1 / k, steps)
        return (gamma[0] / gamma[0].sum()).tolist()

    own = cells.where("weight > 0").join(term_topics, "term").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"), "weights"))).alias("c"))
    return own.select(id_col, topics(F.col("c.weight"), F.col("c.weights")).alias("topics"))


def fold_in(cells: DataFrame, term_topics: DataFrame, id_col: str = "doc_id", steps: int = 20) -> DataFrame:
    """One row (log_likelihood, weight): half of each document's terms infers its topics, the other half is scored by them.

    Halves are dealt by a hash of document and term, so all candidates are held against the same halves; terms unknown to
    the model don't count.
    """
    half = F.pmod(F.xxhash64(id_col, "term"), F.lit(2))
    known = cells.join(term_topics.select("term"), "term", "left_semi")
    topics = infer(known.where(half == 0), term_topics, id_col, steps)
    sums = F.array(*[F.lit(t) for t in totals(term_topics)])
    chances = F.zip_with(F.col("weights"), sums, lambda w, t: w / t)
    scored = known.where(half == 1).join(topics, id_col).join(term_topics, "term")
    chance = F.aggregate(F.zip_with("topics", chances, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return scored.agg(F.sum(F.col("weight") * F.log(chance)).alias("log_likelihood"), F.sum("weight").alias("weight"))


def choose(cells: DataFrame, held_out: DataFrame, candidates: tuple[int, ...], at_once: int = 2, id_col: str = "doc_id", **options) -> tuple[int, dict[int, float], tuple[DataFrame, DataFrame] | None]:
    """The candidate of greatest fold-in likelihood a unit of weight, that of each, and the winner's fit.

    Candidates are trained ``at_once`` at a time as jobs of one session; the first wins a tie, as in a loop.
    """
    candidates = tuple(dict.fromkeys(candidates))

    def trained(k: int) -> tuple[float, tuple[DataFrame, DataFrame]]:
        made = fit(cells, k, id_col=id_col, **options)
        row = fold_in(held_out, made[1], id_col).first()
        return (row["log_likelihood"] / row["weight"] if row["weight"] else float("-inf")), made

    with ThreadPoolExecutor(at_once) as pool:
        found = dict(zip(candidates, pool.map(trained, candidates)))
    best = max(candidates, key=lambda k: (found[k][0], -candidates.index(k)))
    return best, {k: score for k, (score, _) in found.items()}, found[best][1]


def weighted_cells(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
    """(id, term, weight): TF-IDF of every term of (id, words), the input of :func:`fit`."""
    from paperloom.operators import features

    counts = kept(features.counts(docs, id_col, words_col))
    inverse = kept(features.inverse_frequencies(features.document_frequencies(counts), docs))
    return features.tfidf(counts, inverse).select(id_col, "term", F.col("tfidf").alias("weight"))
