"""Substring dedup by fixed-block anchors.

Every document is cut into blocks of ``BLOCK`` words that don't overlap; these are the index. Every rolling
window of ``BLOCK`` words of every document probes it. As 2 * BLOCK - 1 <= WINDOW, a repeated window holds a
whole block of the earlier document, so each repeat is hit. A hit spans the windows of ``WINDOW`` words about
it; these are compared by their own 64-bit hashes, and consecutive equal ones are the maximal exact repeats.

Blocks and probes travel in packed rows: the hash space is cut into buckets, and a row holds what a chunk of
text has in one bucket, 32 bits of each hash, ids once a document, positions as differences. A bucket is
read as a stream: blocks first, folded to the least id of each hash; then probes, which find earlier
blocks and note the largest id that probed a hash; then the blocks again, which learn of later probes. So a task
holds the distinct block hashes of its buckets, never all places of a common passage; the number of buckets
follows the number of words.

Defined cases: null text has no word; a document shorter than a window keeps all; a repeat inside one document
stays; rows repeated under one id are compared with smaller ids only, each text for itself; rows with a null id
neither lose nor take words; an empty table gives an empty result; texts of any length are walked whole; names of
further columns can't clash, as only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import written
from paperloom.llm.shingles import Words, chunks

WINDOW, BLOCK = 13, 7
#: Words of a chunk a bucket, and words a bucket at most on average.
ROW, BUCKET_WORDS = 1000, 3_000_000
FOLD, PROBE, TELL = 0, 1, 2
PACKED = "bucket int, kind int, docs binary, counts binary, prints binary, places binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
HITS = "doc_id long, later array<int>, earlier array<int>"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, as high bytes are mostly 0."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def pack(hashes: np.ndarray, doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, docs, counts, prints, places) of each bucket that has any; doc and place ascend."""
    if not len(hashes):
        return
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, doc, place = bucket[order], doc[order], place[order]
    prints = hashes[order].astype("<u4")
    first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])])
    steps = np.where(first, place, place - np.concatenate([[0], place[:-1]]))
    groups = np.flatnonzero(first)
    counts = np.diff(np.append(groups, len(doc)))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    group_cuts = np.searchsorted(groups, cuts)
    ids = doc[groups].astype("<i8")
    for a, b, c, d in zip(cuts, [*cuts[1:], len(doc)], group_cuts, [*group_cuts[1:], len(groups)]):
        yield int(bucket[a]), ids[c:d].tobytes(), _planes(counts[c:d]), prints[a:b].tobytes(), _planes(steps[a:b])


def unpack(docs: bytes, counts: bytes, prints: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, group starts, prints, places), places from the beginning of their documents."""
    ids, sizes = np.frombuffer(docs, "<i8"), _from_planes(counts)
    starts = np.cumsum(sizes) - sizes
    steps = np.cumsum(_from_planes(places))
    base = np.repeat(np.concatenate([[0], steps])[starts], sizes)
    return ids, starts, np.frombuffer(prints, "<u4"), steps - base


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of the blocks (twice) and rolling windows of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = min(1 << 21, max(1 << 18, ROW * buckets * 6))
            for first, stop, texts in chunks(batch.column("text"), size):
                words = Words(texts)
                ids = np.asarray(batch.column("doc_id").slice(first, stop - first))
                n = np.diff(words.offsets)
                hashes = words.grams(BLOCK)
                owner = np.repeat(np.arange(len(n)), n)
                place = (np.arange(len(owner)) - words.offsets[owner])[: len(hashes)]
                owner = owner[: len(hashes)]
                whole = place + BLOCK <= n[owner]
                block = whole & (place % BLOCK == 0)
                rows = []
                for kinds, mask in (((FOLD, TELL), block), ((PROBE,), whole)):
                    for b, *rest in pack(hashes[mask], ids[owner[mask]], place[mask], buckets):
                        rows += [(b, k, *rest) for k in kinds]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 4)], NAMES)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, PACKED)


class Bucket:
    """Least id and, once probed, largest probing id of each print."""

    def __init__(self):
        self.parts, self.held, self.prints, self.least, self.last = [], 0, None, None, None

    def fold(self, prints: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((prints, ids))
        self.held += len(prints)
        if self.held > 2_000_000:
            self.close()
            self.parts, self.held, self.prints = [(self.prints, self.least)], 0, None

    def close(self) -> None:
        prints, ids = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        order = np.lexsort((ids, prints))
        prints, ids = prints[order], ids[order]
        keep = np.concatenate([[True], prints[1:] != prints[:-1]])[: len(prints)]
        self.parts, self.prints, self.least = [], prints[keep], ids[keep]
        self.last = np.full(len(self.prints), np.iinfo(np.int64).min)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which prints are known, and where these are."""
        if not len(self.prints):
            return np.zeros(len(prints), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        known = self.prints[at] == prints
        return known, at[known]


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """HITS of packed rows that come bucket by bucket, in the order of kinds."""
    number, bucket = None, Bucket()
    empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int32()))
    for batch in batches:
        for b, kind, *raw in zip(*[c.to_pylist() for c in batch.columns]):
            if b != number:
                number, bucket = b, Bucket()
            ids, starts, prints, places = unpack(*raw)
            own = np.repeat(ids, np.diff(np.append(starts, len(prints))))
            if kind == FOLD:
                bucket.fold(prints, own)
                continue
            if bucket.prints is None:
                bucket.close()
            known, at = bucket.find(prints)
            hit = known.copy()
            if kind == PROBE:
                np.maximum.at(bucket.last, at, own[known])
                hit[known] = bucket.least[at] < own[known]
            else:
                hit[known] = bucket.last[at] > own[known]
            if hit.any():
                doc, place = own[hit], places[hit].astype(np.int32)
                cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                found = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(doc)), pa.int32()), pa.array(place))
                none = empty.take(pa.array(np.zeros(len(cuts), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[cuts]), found if kind == PROBE else none, none if kind == PROBE else found], ["doc_id", "later", "earlier"])


def hits(docs: DataFrame) -> DataFrame:
    """HITS: places of windows that match an earlier document's block, and of blocks that a later document probes."""
    spark = docs.sparkSession
    words = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // (6 * BUCKET_WORDS)))
    dealt = anchors(docs, buckets).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(_hits, HITS)


def _spread(places: list | None, n: int, before: int, width: int) -> np.ndarray:
    """A mask of ``n`` that is set from ``before`` before each place on, for ``width``."""
    mask = np.zeros(n + 1, np.int32)
    at = np.asarray(places, np.int64)
    np.add.at(mask, np.clip(at - before, 0, n), 1)
    np.add.at(mask, np.clip(at - before + width, 0, n), -1)
    return np.cumsum(mask[:n]) > 0


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, place, later, hash) of the windows about hits."""
    for batch in batches:
        for first, stop, texts in chunks(batch.column("text")):
            words = Words(texts)
            hashes, part = words.grams(WINDOW), batch.slice(first, stop - first)
            ids, marks = np.asarray(part.column("doc_id")), np.asarray(part.column("text_hash"))
            rows = []
            for i, (later, earlier) in enumerate(zip(part.column("later"), part.column("earlier"))):
                n = int(words.offsets[i + 1] - words.offsets[i]) - WINDOW + 1
                if n <= 0:
                    continue
                for side, places in ((True, later.values), (False, earlier.values)):
                    if places is not None and len(places):
                        at = np.flatnonzero(_spread(np.asarray(places), n, WINDOW - BLOCK, WINDOW - BLOCK + 1))
                        rows.append((np.full(len(at), ids[i]), np.full(len(at), marks[i]), at.astype(np.int32), np.full(len(at), side), hashes[words.offsets[i] + at].view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["doc_id", "text_hash", "place", "later", "hash"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, removed, kept) from (doc_id, text, text_hash, copies)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        for first, stop, texts in chunks(batch.column("text")):
            part, sizes, removed, kept = batch.slice(first, stop - first), [], [], []
            for text, mark, copies in zip(texts, part.column("text_hash").to_pylist(), part.column("copies")):
                words = text.split()
                sizes.append(len(words))
                places = [c["place"] for c in copies.as_py() or () if c["text_hash"] == mark]
                if places:
                    gone = _spread(places, len(words), 0, WINDOW)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    removed.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append([])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed, kept): the removed word spans and the words left, joined by blanks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(hits(rows))
    # Texts are dealt by doc_id once: both joins below have the same left side and read the same exchange.
    every = rows.withColumn("text_hash", F.hash("text"))
    marked, bare = every.where("doc_id is not null"), every.where("doc_id is null")
    merge = lambda c: F.flatten(F.collect_list(c)).alias(c)
    near = marked.join(found.groupBy("doc_id").agg(merge("later"), merge("earlier")), "doc_id")
    windows = near.select("doc_id", "text", "text_hash", "later", "earlier").mapInArrow(_windows, "doc_id long, text_hash int, place int, later boolean, hash long")
    # The join is on another key than the aggregate, so that it has an exchange of its own on either side and adaptive
    # execution can split a hash of very many windows.
    key = F.bitwise_not("hash").alias("key")
    least = windows.where("not later").groupBy("hash").agg(F.min("doc_id").alias("least")).select(key, "least")
    copies = windows.where("later").select("doc_id", "text_hash", "place", key).join(least, "key").where("least < doc_id")
    per_doc = copies.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "place")).alias("copies"))
    cut = lambda d: d.select("doc_id", "text", "text_hash", "copies").mapInArrow(_cut, "doc_id long, n_words long, removed array<struct<start:int,stop:int>>, kept string")
    none = F.lit(None).cast("array<struct<text_hash:int,place:int>>")
    return cut(marked.join(per_doc, "doc_id", "left")).unionByName(cut(bare.withColumn("copies", none)))
