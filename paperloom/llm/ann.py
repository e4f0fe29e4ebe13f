"""Approximate nearest neighbours by additive quantisation.

``fit`` trains ``BOOKS`` full-dimensional codebooks on a bounded sample: residual k-means, then rounds of
beam-search encoding and least-squares updates of all codebooks together. ``encode`` gives every vector a
code by beam search and stores its norm over that of its reconstruction. ``search`` scores blocks of queries
against blocks of codes from lookup tables, times the stored norms, and keeps the ``SHORTLIST`` best codes of a
query over all blocks; their vectors alone are fetched and reranked by the exact inner product.

The sample only shapes the codebooks; every row is encoded and searched. The query set is a stated one, and
both sides go in blocks of fixed size, so no task holds more than a block of each. What is copied to every block
of queries are codes; vectors go to a block of queries once if it has them on a shortlist. Blocks are dealt by
hashes, so a block holds its share of a shortlist; it sends so many more that one is cut off with a chance of about one
in a million.

Defined cases: vectors that are null, empty, zero, hold null, NaN or infinite components, or have another
dimension than most, take no part; rows repeated under one id count once, with the smallest vector; ties go
to the smaller id; with fewer candidates than asked for, all are returned; an empty table gives an empty
result; further columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import written

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors at most in the training sample, taken in the order of a hash of their ids.
SAMPLE = 6144
#: A joint round encodes the sample anew and fits all codebooks to it by SWEEPS over them, each word held back by KEEP vectors of its own.
KMEANS_ROUNDS, JOINT_ROUNDS, SWEEPS, KEEP = 6, 2, 8, 0.5
#: Codes of a query that are reranked, over all blocks.
SHORTLIST = 1200
QUERY_BLOCK, CODE_BLOCK = 8192, 32768


class Quantiser:
    """A vector is approximated by the sum of one word from each codebook."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # (book, word, dimension)
        self.norms = np.einsum("mwd,mwd->mw", self.books, self.books)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows of ``x`` and their norms over those of their reconstructions.

        A beam keeps the partial codes of least squared residual, and these residuals.
        """
        codes, norms = [np.zeros((0, len(self.books)), np.uint8)], [np.zeros(0, np.float32)]
        for a in range(0, len(x), 512):
            part = x[a : a + 512].astype(np.float32)
            n, rows = len(part), np.arange(len(part))[:, None]
            code, rest = np.zeros((n, 1, 0), np.uint8), part[:, None, :]
            error = np.einsum("nd,nd->n", part, part)[:, None]
            for norm, book in zip(self.norms, self.books):
                cost = (rest.reshape(-1, rest.shape[2]) @ (-2 * book.T)).reshape(n, -1, len(book))
                cost += norm
                cost += error[:, :, None]
                flat = cost.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                error = flat[rows, best]
                parent, word = best // len(book), best % len(book)
                code = np.concatenate([code[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
                rest = rest[rows, parent] - book[word]
            least = error.argmin(axis=1)
            rebuilt = part - rest[rows[:, 0], least]
            codes.append(code[rows[:, 0], least])
            norms.append(np.linalg.norm(part, axis=1) / np.maximum(np.linalg.norm(rebuilt, axis=1), 1e-20))
        return np.concatenate(codes), np.concatenate(norms)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 0) -> Quantiser:
    """Residual k-means, then least-squares rounds of all codebooks together, one after the other, over the sample ``x``."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, found = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(KMEANS_ROUNDS):
            nearest = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, rest)
            counts = np.bincount(nearest, minlength=words)
            centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        nearest = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        rest = rest - centres[nearest]
        found.append(centres)
    model = Quantiser(np.stack(found))
    for _ in range(JOINT_ROUNDS):
        codes, _ = model.encode(x)
        found = model.books.copy()
        rest = x - model.decode(codes)
        for _ in range(SWEEPS):
            for own, code in zip(found, codes.T):
                wanted = rest + own[code]
                sums = np.zeros_like(own)
                np.add.at(sums, code, wanted)
                sums += KEEP * own
                own[:] = sums / (np.bincount(code, minlength=words) + KEEP)[:, None]
                rest = wanted - own[code]
        model = Quantiser(found)
    return model


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): one finite, non-zero vector an id, all of the most frequent dimension."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.exists(x, lambda c: c != 0)
    sound &= F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).groupBy(F.col(id_col).alias("vec_id")).agg(F.min(x).alias("x"))
    most = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("x") == (most[0]["n"] if most else 0))


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Quantiser | None:
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toArrow()
    return train(_matrix(rows.column("x").combine_chunks())) if rows.num_rows else None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def encode(vectors: DataFrame, model: Quantiser) -> DataFrame:
    """(vec_id, code, norm) of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = shared.value.encode(_matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["vec_id", "code", "norm"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, code binary, norm float")


def shortlist(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest; among equals the first ones."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = scores[np.argpartition(-scores, n - 1)[:n]].min()
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])


def _sorted(rows: pa.Table, by: str) -> pa.Table:
    return rows.sort_by(by).combine_chunks() if rows.num_rows else rows


def _ints(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().astype(np.int64)


def _lists(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: np.concatenate(c) for n, c in zip(names, zip(*found))})


def score_block(model: Quantiser, queries: pa.Table, index: pa.Table, keep: int) -> pa.Table:
    """(query_id, vec_id, about): the ``keep`` best codes of a block for each query of a block, by the lookup tables."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    if queries.num_rows and index.num_rows:
        queries, index = _sorted(queries, "vec_id"), _sorted(index, "vec_id")
        ids, norms = _ints(index, "vec_id"), index.column("norm").to_numpy().astype(np.float32)
        codes = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).T.copy()
        for query_id, own in zip(_ints(queries, "vec_id"), _matrix(queries.column("x").chunk(0)).astype(np.float32)):
            table = model.books @ own
            scores = table[0][codes[0]]
            for m in range(1, len(codes)):
                scores += table[m][codes[m]]
            scores *= norms
            at = shortlist(scores, keep + 1)
            at = at[ids[at] != query_id]
            out.append((np.full(len(at), query_id), ids[at], scores[at]))
    return _lists(out, ("query_id", "vec_id", "about"))


def rerank_block(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the best ``k`` of the vectors on each query's list ``found`` by the exact inner product."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if queries.num_rows:
        queries, vectors = _sorted(queries, "query_id"), _sorted(vectors, "wanted_id")
        ids, x, asked = _ints(vectors, "wanted_id"), _matrix(vectors.column("wanted").chunk(0)), _matrix(queries.column("x").chunk(0))
        for query_id, own, found in zip(_ints(queries, "query_id"), asked, queries.column("found")):
            at = np.searchsorted(ids, np.sort(found.values.to_numpy()))
            exact = (x[at] * own).sum(axis=1)
            order = np.lexsort((ids[at], -exact))[:k]
            out.append((np.full(len(order), query_id), ids[at][order], exact[order]))
    return _lists(out, ("query_id", "vec_id", "score"))


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows to each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    query_blocks, code_blocks = max(1, -(-counts["q"] // QUERY_BLOCK)), max(1, -(-counts["n"] // CODE_BLOCK))
    share = keep / code_blocks
    sent = min(keep, int(share + 5 * share**0.5 + 20))
    query_block = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block")
    code_block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(code_blocks)).cast("int").alias("code_block")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks, queries = ["query_block", "code_block"], rows.where(F.col("vec_id") % every == 0)
    asked = queries.select("vec_id", "x", query_block("vec_id"), each(code_blocks).alias("code_block"))
    index = encode(rows, model).select("vec_id", "code", "norm", code_block, each(query_blocks).alias("query_block"))
    shared = spark.sparkContext.broadcast(model)

    def scored(queries: pa.Table, index: pa.Table) -> pa.Table:
        return score_block(shared.value, queries, index, sent)

    def reranked(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        return rerank_block(queries, vectors, k)

    about = asked.groupBy(*blocks).cogroup(index.groupBy(*blocks)).applyInArrow(scored, "query_id long, vec_id long, about float")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id"))
    short = about.withColumn("nth", best).where(F.col("nth") <= keep).select("query_id", "vec_id", query_block("query_id"), code_block)
    short = written(short)
    needed = short.select(*blocks, "vec_id").distinct().join(rows, "vec_id").toDF("wanted_id", "wanted_by", "wanted_block", "wanted")
    lists = short.groupBy(*blocks, "query_id").agg(F.collect_list("vec_id").alias("found"))
    lists = lists.join(queries.select(F.col("vec_id").alias("query_id"), "x"), "query_id")
    found = lists.groupBy(*blocks).cogroup(needed.groupBy("wanted_by", "wanted_block")).applyInArrow(reranked, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
