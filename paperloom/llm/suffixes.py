"""Substring dedup by a logarithmic family of suffix arrays.

A document is its UTF-8 bytes; a window is ``LENGTH`` consecutive ones. A window's mark is the least hash of the grams of
``GRAM`` bytes in it, so equal windows have equal marks wherever they stand. Consecutive windows of one mark are a run,
about fifteen of them. Marks are looked up once, in packed rows dealt to buckets: a bucket folds the least and the
greatest id that hold each mark, then lets through the runs whose mark another id has. Only their bytes travel on, as
segments (a run's windows and nothing else), equal segments of a batch as one. A text equal to one of a smaller id
is all covered by it, so it sends no segments.

Segments are dealt to shards by their marks, so that all places of a window meet in one shard. Batches come in
ascending ids. A batch gets a suffix array in each shard: its windows in the order of their bytes. It is
merge-scanned against the arrays of all levels, in which equal windows are matches with an earlier batch; neighbours
in its own array are matches inside the batch. Then it becomes a level, and levels of equal rank merge into one of
the next rank, in which equal windows are kept once. So b batches make log2(b) levels and every window is merged log2(b) times.

A mark that very many runs hold is cut finer, by the least hash of grams of twice the size, in all its runs alike.
A shard is loaded by one task: its different segments of the batch, and its part of the levels. The number of
shards and buckets follows the number of bytes.

Defined cases: null or empty text has no bytes; texts shorter than a window keep all; a repeat inside one document
stays; rows repeated under one id are compared with smaller ids only, each text for itself; rows with a null id
neither lose nor take bytes; an empty table gives an empty result; texts of any length are walked whole, in slices; what is
left may not be UTF-8 and is binary; names of further columns can't clash, as only id and text are read. Runs are found
by 32-bit prints and equal segments by two 64-bit hashes (chance of 2**-128 a pair); windows are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, written
from paperloom.llm.shingles import mix
from paperloom.llm.substrings import NAMES, PACKED, pack, unpack

LENGTH, GRAM = 50, 24
#: Batches that a table is cut into.
BATCHES = 4
#: Runs of one mark from which it is cut finer.
FREQUENT = 50_000
#: Bytes of a text looked at at once; runs a bucket and bytes of segments a shard at most on average.
SLICE, BUCKET_RUNS, SHARD_BYTES = 1 << 20, 1_500_000, 1 << 20
FOLD, PROBE = 0, 1
COPY, HIT, TEXT = 0, 1, 2
LEVEL, NEW = 0, 1
HITS = "share int, docs binary, places binary, often binary"
SEGMENTS = "mark long, segment binary, doc_id long, text_hash int, start int"
SHARDED = "kind int, shard int, bytes binary, places binary, mark long, print long, least long, most long"
ANSWERS = "kind int, shard int, bytes binary, places binary, mark long, print long, repeats array<struct<start:int,stop:int,least:long>>"
NO_ID, ANY_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _sliding(least: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    return np.minimum(least[: len(least) - width + n], least[width - n :]) if n < width else least


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal, neighbouring keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


class Windows:
    """All windows of some byte strings: ``owner`` and ``place`` of each, its ``mark``, and its finer mark."""

    def __init__(self, parts: list[bytes], finer: bool = False):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends, count = np.cumsum(sizes), max(0, len(raw) - LENGTH + 1)
        owner = np.repeat(np.arange(len(parts)), sizes)[:count]
        whole = np.arange(count) + LENGTH <= ends[owner]
        self.owner = owner[whole]
        self.place = np.flatnonzero(whole) - (ends - sizes)[self.owner]
        self.mark = self.fine = np.zeros(0, np.uint64)
        if len(self.owner):
            word = raw.astype(np.uint64)
            for n in (1, 2, 4):
                word = word[:-n] << np.uint64(8 * n) | word[n:]
            gram = mix(mix(mix(word[:-16], 40) + word[8:-8], 41) + word[16:], 45)
            self.mark = _sliding(gram, LENGTH - GRAM + 1)[whole]
            if finer:
                gram = mix(gram[:-GRAM] + mix(gram[GRAM:], 42), 43)
                self.fine = _sliding(gram, LENGTH - 2 * GRAM + 1)[whole]


def _sliced(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(rows, offsets, bytes) of about SLICE bytes together: slices of ``texts`` that share what a window needs."""
    rows, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(0, len(text or b"") - LENGTH + 1), SLICE):
            part = text[a : a + SLICE + LENGTH - 1]
            if held and held + len(part) > SLICE:
                yield rows, offsets, parts
                rows, offsets, parts, held = [], [], [], 0
            rows.append(i)
            offsets.append(a)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, offsets, parts


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def _packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """PACKED rows of the runs of (doc_id, text), to fold and to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for rows, offsets, parts in _sliced(_texts(batch)):
                windows, out = Windows(parts), []
                at = _starts(windows.owner, windows.mark)
                owner = windows.owner[at]
                place = windows.place[at] + np.asarray(offsets)[owner]
                for bucket, docs, counts, prints, places in pack(windows.mark[at], ids[np.asarray(rows)[owner]], place, buckets):
                    out += [(bucket, FOLD, docs, counts, prints, None), (bucket, PROBE, docs, counts, prints, places)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int32()] * 2 + [pa.binary()] * 4)], NAMES)

    return run


class Held:
    """Least and greatest id of each print, and how many runs have it."""

    def __init__(self):
        self.print, self.least, self.most, self.count = np.zeros(0, "<u4"), *[np.zeros(0, np.int64)] * 3
        self.parts, self.waiting = [], 0

    def fold(self, prints: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((prints, ids, ids, np.ones(len(ids), np.int64)))
        self.waiting += len(ids)
        if self.waiting > max(500_000, len(self.print)):
            self.close()

    def close(self) -> None:
        if self.parts:
            columns = [np.concatenate(c) for c in zip((self.print, self.least, self.most, self.count), *self.parts)]
            order = np.argsort(columns[0], kind="stable")
            prints, least, most, count = (c[order] for c in columns)
            at = _starts(prints)
            self.print, self.least = prints[at], np.minimum.reduceat(least, at)
            self.most, self.count = np.maximum.reduceat(most, at), np.add.reduceat(count, at)
            self.parts, self.waiting = [], 0


def _share(ids: np.ndarray, shares: int) -> np.ndarray:
    """The share of documents that an id is dealt to."""
    return (mix(ids.astype(np.int64).view(np.uint64), 46) % np.uint64(shares)).astype(np.int32)


def _found(frequent: int, shares: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """HITS of packed rows that come bucket by bucket, first those to fold: the runs whose mark another id has, by shares of ids."""

    def dealt(parts: list[tuple]) -> pa.RecordBatch:
        doc, place, often = (np.concatenate(c) for c in zip(*parts))
        share = _share(doc, shares)
        order = np.argsort(share, kind="stable")
        share, doc, place, often = (c[order] for c in (share, doc, place, often))
        cuts = np.append(_starts(share), len(share)).tolist()
        raw = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in (doc.astype("<i8"), place.astype("<i4"), often)]
        return pa.RecordBatch.from_arrays([pa.array(share[cuts[:-1]]), *raw], ["share", "docs", "places", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, parts, waiting = None, Held(), [], 0
        for batch in batches:
            for bucket, kind, docs, counts, prints, places in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket != number:
                    number, held = bucket, Held()
                ids, groups, prints, places = unpack(docs, counts, prints, places if kind == PROBE else bytes(len(prints)))
                own = np.repeat(ids, np.diff(np.append(groups, len(prints))))
                if kind == FOLD:
                    held.fold(prints, own)
                    continue
                held.close()
                at = np.searchsorted(held.print, prints)
                hit = held.least[at] < held.most[at]
                parts.append((own[hit], places[hit], held.count[at[hit]] > frequent))
                waiting += int(hit.sum())
                if waiting > 1_000_000:
                    yield dealt(parts)
                    parts, waiting = [], 0
        if waiting:
            yield dealt(parts)

    return run


class Wanted:
    """The runs of a share's documents, and which texts are copies."""

    def __init__(self):
        self.parts, self.copies, self.docs = [], set(), None

    def close(self) -> None:
        if self.docs is None:
            doc, place, often = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, "<i8"), np.zeros(0, "<i4"), np.zeros(0, bool))
            order = np.argsort(doc, kind="stable")
            self.docs, self.places, self.often, self.parts = doc[order], place[order].astype(np.int64), often[order], []

    def of(self, doc: int, text_hash: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs to send, and of those of them that are frequent."""
        a, b = np.searchsorted(self.docs, [doc, doc + 1])
        if (doc, text_hash) in self.copies:
            a = b
        return self.places[a:b], self.places[a:b][self.often[a:b]]


def _among(owner: np.ndarray, place: np.ndarray, rows: list[int], offsets: list[int], wanted: list[np.ndarray]) -> np.ndarray:
    """Which runs (of parts that are slices of rows, from offsets on) are at a wanted place of their row."""
    keys = [(k << 32) + x[(x >= a) & (x < a + SLICE)] - a for k, (i, a) in enumerate(zip(rows, offsets)) for x in (wanted[i],) if len(x)]
    keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    if not len(keys):
        return np.zeros(len(owner), bool)
    own = (owner << 32) + place
    return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SEGMENTS of (share, kind, doc_id, text_hash, text, docs, places, often) that come share by share, texts last."""
    number, held = None, Wanted()
    for batch in batches:
        shares, kinds = np.asarray(batch.column("share")), np.asarray(batch.column("kind"))
        cuts = _starts(shares, kinds)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shares)]):
            if shares[a] != number:
                number, held = shares[a], Wanted()
            part = batch.slice(a, b - a)
            if kinds[a] == COPY:
                held.copies.update(zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()))
            elif kinds[a] == HIT:
                held.parts += [(np.frombuffer(d, "<i8"), np.frombuffer(p, "<i4"), np.frombuffer(o, bool)) for d, p, o in zip(*[part.column(c).to_pylist() for c in ("docs", "places", "often")])]
            else:
                held.close()
                wanted, often = zip(*[held.of(i, h) for i, h in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist())])
                some = [len(w) > 0 for w in wanted]
                if any(some):
                    keep = [i for i, x in enumerate(some) if x]
                    yield from _cut_segments(part.take(pa.array(keep)), [wanted[i] for i in keep], [often[i] for i in keep])


def _cut_segments(batch: pa.RecordBatch, wanted: list[np.ndarray], often: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """SEGMENTS of the wanted runs of (doc_id, text_hash, text)."""
    for rows, offsets, parts in _sliced(_texts(batch)):
        windows = Windows(parts, finer=any(len(often[i]) for i in rows))
        at = _starts(windows.owner, windows.mark)
        length, owner = np.diff(np.append(at, len(windows.mark))), windows.owner[at]
        place = windows.place[at]
        keep, fine = (_among(owner, place, rows, offsets, c) for c in (wanted, often))
        mark = windows.mark
        if fine.any():  # all runs of such a mark are cut where the finer mark changes
            inside, mark = np.repeat(fine, length), mark.copy()
            mark[inside] = mix(mark[inside] ^ windows.fine[inside], 44)
            kept = np.repeat(keep, length)
            at = np.union1d(at, _starts(windows.owner, mark))
            length, owner, place, keep = np.diff(np.append(at, len(mark))), windows.owner[at], windows.place[at], kept[at]
        if keep.any():
            at, length, owner, place = at[keep], length[keep], owner[keep], place[keep]
            cut = [parts[k][p : p + n + LENGTH - 1] for k, p, n in zip(owner.tolist(), place.tolist(), length.tolist())]
            row = pa.array(np.asarray(rows)[owner])
            start = (place + np.asarray(offsets)[owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(mark[at].view(np.int64)), pa.array(cut, pa.binary()), batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array(start)], ["mark", "segment", "doc_id", "text_hash", "start"])


def windows_at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The windows at ``places``, as fixed strings."""
    if not len(places):
        return np.zeros(0, f"S{LENGTH}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[places]).view(f"S{LENGTH}").reshape(-1)


def suffix_array(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``windows`` by their bytes, and where equal ones begin in it: sorted by eight bytes, ties by the next eight."""
    n = len(windows)
    raw = windows.view(np.uint8).reshape(n, LENGTH)

    def eight(at: int, rows: np.ndarray | slice) -> np.ndarray:
        """Eight bytes of ``rows`` from ``at`` on, as numbers in their order."""
        part = raw[rows, at : at + 8]
        if part.shape[1] < 8:
            part = np.hstack([part, np.zeros((len(part), 8 - part.shape[1]), np.uint8)])
        return np.ascontiguousarray(part).view(">u8").reshape(-1).astype(np.uint64)

    value = eight(0, slice(None))
    order = np.argsort(value)
    value = value[order]
    same = np.concatenate([[False], value[1:] == value[:-1]])[:n]
    for at in range(8, LENGTH, 8):
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        group, rows = np.cumsum(~same)[tied], order[tied]
        value = eight(at, rows)
        by = np.lexsort((value, group))
        order[tied], value = rows[by], value[by]
        same[tied[1:]] = (group[1:] == group[:-1]) & (value[1:] == value[:-1])
    return order, np.flatnonzero(~same)


def scan(raw: np.ndarray, sizes: np.ndarray, least: np.ndarray, most: np.ndarray, levels: dict[int, tuple[bytes, bytes]], merged_from: int, store: bool) -> tuple[list[np.ndarray], tuple[bytes, bytes] | None]:
    """(segment, start, stop, least) of the repeats in a shard's new segments, and the new level of the shard.

    The segments of ``sizes`` bytes stand one after the other in ``raw``; ``least`` and ``most`` are the ids that hold each.
    ``levels`` are (bytes, places in suffix order) by their numbers; those from ``merged_from`` on join the new one.
    """
    begins, count = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    windows = windows_at(raw, begins[owner] + inside)
    order, firsts = suffix_array(windows)
    earliest = np.minimum.reduceat(least[owner[order]], firsts) if len(firsts) else least[:0]
    different = windows[order[firsts]]
    texts, places, keys, shift = [raw], [(begins[owner] + inside)[order[firsts]]], [different], len(raw)
    for k, (b, p) in levels.items():
        own_raw, own_places = np.frombuffer(b, np.uint8), np.frombuffer(p, "<i4").astype(np.int64)
        old = windows_at(own_raw, own_places)
        if len(old):
            at = np.minimum(np.searchsorted(old, different), len(old) - 1)
            earliest = np.where(old[at] == different, ANY_ID, earliest)
        if store and k >= merged_from:
            texts.append(own_raw)
            places.append(own_places + shift)
            keys.append(old)
            shift += len(own_raw)
    found = np.empty(len(owner), np.int64)
    found[order] = np.repeat(earliest, np.diff(np.append(firsts, len(order))))
    found = np.where(found < most[owner], found, NO_ID)
    bounds = _starts(owner, found)
    stops = np.append(bounds[1:], len(owner))
    hit = found[bounds] != NO_ID
    bounds, stops = bounds[hit], stops[hit]
    rows = [owner[bounds], inside[bounds], inside[bounds] + stops - bounds, found[bounds]]
    if not store:
        return rows, None
    keys, places, raw = np.concatenate(keys), np.concatenate(places), np.concatenate(texts)
    by = np.argsort(keys, kind="stable")  # a merge, as each part is in order
    keys, places = keys[by], places[by][_starts(keys[by])]
    cover = np.zeros(len(raw) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + LENGTH, -1)
    stays = np.cumsum(cover[:-1]) > 0
    moved = np.cumsum(stays) - 1
    return rows, (raw[stays].tobytes(), moved[places].astype("<i4").tobytes())


def _scanned(merged_from: int, store: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ANSWERS of SHARDED rows that come shard by shard, levels first."""
    names = ["kind", "shard", "bytes", "places", "mark", "print", "repeats"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("least", pa.int64())]))]

    def answers(shard: int, new: list[pa.RecordBatch], levels: dict) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(memoryview(_bytes_of(b.column("bytes"))) for b in new), np.uint8)
        column = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.asarray(b.column(c)) for b in new]])
        sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(np.asarray(_offsets(b.column("bytes")))) for b in new]])
        (owner, start, stop, least), level = scan(raw, sizes, column("least"), column("most"), levels, merged_from, store)
        cuts = _starts(owner)
        for a in range(0, len(cuts), 20_000):
            part = np.append(cuts, len(owner))[a : a + 20_001]
            own = slice(part[0], part[-1])
            repeats = pa.StructArray.from_arrays([pa.array(start[own].astype(np.int32)), pa.array(stop[own].astype(np.int32)), pa.array(least[own])], ["start", "stop", "least"])
            n, of = len(part) - 1, owner[part[:-1]]
            lists = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), repeats)
            columns = [pa.array(np.full(n, NEW), pa.int32()), pa.array(np.full(n, shard), pa.int32()), *[pa.nulls(n, pa.binary())] * 2, pa.array(column("mark")[of]), pa.array(column("print")[of]), lists]
            yield pa.RecordBatch.from_arrays(columns, names)
        if level is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((LEVEL, shard, *level, None, None, None), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, new, levels = None, [], {}
        for batch in batches:
            shards, of_kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            cuts = _starts(shards, of_kind)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shards)]):
                if shards[a] != number:
                    if number is not None:
                        yield from answers(number, new, levels)
                    number, new, levels = int(shards[a]), [], {}
                part = batch.slice(a, b - a)
                if of_kind[a] == NEW:
                    new.append(part)
                else:
                    levels |= {k: (raw, places) for k, raw, places in zip(*[part.column(c).to_pylist() for c in ("least", "bytes", "places")])}
        if number is not None:
            yield from answers(number, new, levels)

    return run


def _offsets(column: pa.Array) -> np.ndarray:
    large = pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _bytes_of(column: pa.Array) -> bytes:
    """All bytes of a binary column, one value after the other."""
    offsets, data = _offsets(column), column.buffers()[2]
    return data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None and len(offsets) else b""


class Family:
    """Levels of suffix arrays over all batches so far: tables (shard, bytes, places), the largest first, each with its rank."""

    def __init__(self, shards: int):
        self.shards, self.levels = shards, []

    def add(self, segments: DataFrame, store: bool = True) -> DataFrame:
        """(mark, print, repeats) of SEGMENTS rows, written: windows of each different segment that a row of an earlier batch
        or of a smaller id (``least``) has. Without ``store`` the batch becomes no level."""
        each = segments.groupBy("mark", F.col("segment").alias("bytes")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).withColumn("print", F.xxhash64("bytes"))
        null = lambda kind: F.lit(None).cast(kind)
        rows = each.select(F.lit(NEW).alias("kind"), F.pmod(F.xxhash64("mark"), F.lit(self.shards)).cast("int").alias("shard"), "bytes", null("binary").alias("places"), "mark", "print", "least", "most")
        for k, (_, level) in enumerate(self.levels):
            rows = rows.unionByName(level.where(F.col("kind") == LEVEL).select("kind", "shard", "bytes", "places", null("long").alias("mark"), null("long").alias("print"), F.lit(k).cast("long").alias("least"), null("long").alias("most")))
        rank, merging = 0, 0
        while merging < len(self.levels) and self.levels[-1 - merging][0] == rank:
            rank, merging = rank + 1, merging + 1
        dealt = rows.repartitionById(self.shards, "shard").sortWithinPartitions("shard", "kind")
        found = written(dealt.mapInArrow(_scanned(len(self.levels) - merging, store), ANSWERS), compression="zstd")
        if store:
            merged = self.levels[len(self.levels) - merging :]
            self.levels[len(self.levels) - merging :] = [(rank, found)]
            discard(*[level for _, level in merged])
        return found


def runs_of(rows: DataFrame, frequent: int, shares: int) -> DataFrame:
    """HITS of (doc_id, text)."""
    packed = rows.select("doc_id", "text").mapInArrow(_packed(shares), PACKED)
    return packed.repartitionById(shares, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_found(frequent, shares), HITS)


def copies_of(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_bytes) of the rows of (doc_id, text, text_hash) whose whole text a smaller id has."""
    each = rows.select("doc_id", "text_hash", F.octet_length("text").alias("n_bytes"), F.unhex(F.md5("text")).alias("digest")).distinct()
    first = each.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return each.join(first.hint("merge"), "digest").where("least < doc_id").select("doc_id", "text_hash", "n_bytes")


def segments_of(rows: DataFrame, copies: DataFrame, held: int, frequent: int = FREQUENT, cuts: list[int] | None = None) -> DataFrame:
    """SEGMENTS of (doc_id, text_hash, text) of ``held`` bytes but for ``copies``, written by batch: the number of ``cuts`` below the id."""
    shares = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // (16 * BUCKET_RUNS)))
    found = written(runs_of(rows, frequent, shares))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("share", pa.array(_share(np.asarray(batch.column("doc_id")), shares)))

    dealt = lambda d, kind: d.mapInArrow(deal, d._jdf.schema().toDDL() + ", share int").withColumn("kind", F.lit(kind))
    own = dealt(rows.select("doc_id", "text_hash", "text"), TEXT)
    every = own.unionByName(found.withColumn("kind", F.lit(HIT)), allowMissingColumns=True).unionByName(dealt(copies.select("doc_id", "text_hash"), COPY), allowMissingColumns=True)
    cut = every.repartitionById(shares, "share").sortWithinPartitions("share", "kind").mapInArrow(_segments, SEGMENTS)
    out = written(cut.withColumn("batch", sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts or []), F.lit(0))), by="batch", compression="zstd")
    discard(found)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, removed, kept) of (doc_id, text, found)."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        removed, kept, sizes = [], [], []
        for text, spans in zip(_texts(batch), batch.column("found")):
            text, gone, left, at = text or b"", [], [], 0
            flat = spans.values.flatten() if spans.is_valid else [np.zeros(0, np.int32)] * 2
            starts, stops = (np.asarray(c) for c in flat)
            order = np.argsort(starts, kind="stable")
            for a, b in zip(starts[order].tolist(), stops[order].tolist()):
                if gone and a <= gone[-1]["stop"]:
                    gone[-1]["stop"] = max(b, gone[-1]["stop"])
                else:
                    gone.append({"start": a, "stop": b})
            for s in gone:
                left.append(text[at : s["start"]])
                at = s["stop"]
            removed.append(gone)
            kept.append(b"".join([*left, text[at:]]))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: the maximal removed byte spans and the bytes left."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.hash(text_col).alias("text_hash"))
    marked, bare = rows.where("doc_id is not null"), rows.where("doc_id is null")
    long = marked.where(F.octet_length("text") >= LENGTH)
    shares = F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000) if batches > 1 else F.array().cast("array<long>")
    held, cuts = long.agg(F.sum(F.octet_length("text")), shares).first()
    held, cuts = held or 0, sorted(set(cuts or []))
    copies = written(copies_of(long))
    whole = segments_of(long, copies, held, frequent, cuts)
    family = Family(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // (SHARD_BYTES * batches))))
    per_batch = []
    for k in range(len(cuts) + 1):
        own = whole.where(F.col("batch") == k).drop("batch")
        found = family.add(own, store=k < len(cuts))
        answers = found.where(F.col("kind") == NEW).select("mark", "print", "repeats").hint("shuffle_hash")
        hit = own.select("mark", F.xxhash64("segment").alias("print"), "doc_id", "text_hash", "start").join(answers, ["mark", "print"])
        spans = F.transform(F.filter("repeats", lambda r: r["least"] < F.col("doc_id")), lambda r: F.struct((F.col("start") + r["start"]).alias("start"), (F.col("start") + r["stop"] + F.lit(LENGTH - 1)).alias("stop")))
        per_batch.append(written(hit.select("doc_id", "text_hash", spans.alias("spans")).where(F.size("spans") > 0)))
        if k == len(cuts):
            discard(found, whole, *[level for _, level in family.levels])
    spans = copies.select("doc_id", "text_hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    for part in per_batch:
        spans = spans.unionByName(part)
    per_doc = written(spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("found")))
    discard(copies, *per_batch)
    cut = lambda d: d.select("doc_id", "text", "found").mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary")
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    return cut(marked.join(per_doc, ["doc_id", "text_hash"], "left")).unionByName(cut(bare.withColumn("found", none)))
