"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

A document becomes its token ids and one closing id. Only documents longer than a sequence are cut;
their first piece takes the remainder, so that every further piece fills a sequence by itself.
Pieces are dealt to shards of about ``SHARD`` pieces by a hash, each packed on its own (a shard wastes
less than one sequence more than the whole would). A shard starts from best fit in descending order;
then pieces are moved and exchanged (one for one, two for one and one for two) between underfull bins wherever that
raises the sum of squared fills, until no exchange helps; bins run empty on the way.

The vocabulary is read from the tokenizer's own file and run by the faster of two libraries; tests hold its ids
against those of the file's library.

Defined cases: null or empty text is the closing id alone; the strings of added tokens give
those, as the file's library does without further settings; an empty table gives an empty result; rows repeated under one id are packed each for itself and told apart by
``row_id``; long texts give as many pieces as they need; further columns are passed by.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import freed, written

LENGTH = 2048
CLOSING = 0
#: Pieces a shard.
SHARD = 16384

PIECES = "piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Text -> its ids as little-endian 32-bit bytes, by the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"added tokens that depend on what stands beside them: {path}")
        special = {t["content"]: t["id"] for t in added}
        # Byte-level vocabularies write bytes as printable characters: the printable ones of Latin-1
        # stand for themselves, the others follow from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocabulary.items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = "all" if special else set()

    def encode(self, text: str) -> bytes:
        return array("I", self.encoding.encode(text, allowed_special=self.special, disallowed_special=())).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """(id, row_id, piece, start, length, ids_crc32[, ids]) of every document; row_id numbers the rows of ``docs``."""
    end = np.array([closing], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, numbers = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = encoded.encode(text or "") + end
                    for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                        own = ids[4 * start : 4 * (start + n)]
                        numbers.append(i)
                        rows.append((k, start, n, zlib.crc32(own), own))
                columns = list(zip(*rows))
                at_rows = pa.array(numbers, pa.int32())
                out = [part.column("id").take(at_rows), part.column("row_id").take(at_rows), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:4]]]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["id", "row_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row_id long, {PIECES}" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text")).mapInArrow(freed(encode), schema).withColumnRenamed("id", id_col)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: pieces in descending order, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        above = rooms >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


class LocalSearch:
    """Exchanges between underfull bins; every one of them raises the sum of squared fills.

    Bins are kept by the sizes of their pieces, and the underfull bins that hold a size, or two pieces of a sum, in
    heaps by their fill; entries that are no longer true are dropped when they come up. So an exchange is
    found by sizes, however many pieces have one.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.capacity, self.bins, self.fill = capacity, [], []
        for members in bins:
            own: dict[int, list[int]] = {}
            for i in members:
                own.setdefault(sizes[i], []).append(i)
            self.bins.append(own)
            self.fill.append(sum(sizes[i] for i in members))
        self.open = {b for b, f in enumerate(self.fill) if f < capacity}
        #: For one piece and for two: size or sum -> heap of (fill, bin); which sizes or sums have a heap, as bits.
        self.heaps: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        self.has = [0, 0]
        for b in sorted(self.open):
            self.enter(b)

    def sums(self, b: int) -> set[int]:
        """The sums of two pieces of a bin, none above the capacity."""
        own = sorted(self.bins[b])
        return {x + y for k, x in enumerate(own) for y in own[k:] if x != y or len(self.bins[b][x]) > 1}

    def enter(self, b: int) -> None:
        for kind, values in enumerate((self.bins[b], self.sums(b))):
            for z in values:
                heappush(self.heaps[kind][z], (self.fill[b], b))
                self.has[kind] |= 1 << z

    def pair(self, b: int, z: int) -> tuple[int, int] | None:
        """The sizes of two pieces of a bin with sum ``z``, the smaller one first and least."""
        own = self.bins[b]
        return min(((x, z - x) for x in own if x <= z - x and z - x in own and (2 * x != z or len(own[x]) > 1)), default=None)

    def partner(self, kind: int, z: int, b: int, below: int) -> int | None:
        """The emptiest other bin that holds ``z`` if it is filled less than ``below``."""
        heap, own = self.heaps[kind][z], None
        while heap:
            fill, a = heap[0]
            if a not in self.open or fill != self.fill[a] or not (self.pair(a, z) if kind else z in self.bins[a]):
                heappop(heap)
            elif a == b:
                own = heappop(heap)
                while heap and heap[0] == own:
                    heappop(heap)
            else:
                break
        found = heap[0][1] if heap and heap[0][0] < below else None
        if own:
            heappush(heap, own)
        if not heap:
            self.has[kind] &= ~(1 << z)
        return found

    def swap(self, b: int, ours: tuple[int, ...], a: int, theirs: tuple[int, ...]) -> None:
        """Pieces of the sizes ``ours`` go from ``b`` to ``a``, and ``theirs`` the other way."""
        moves = []
        for here, there, given in ((b, a, ours), (a, b, theirs)):
            for s in given:
                moves.append((there, s, self.bins[here][s].pop()))
                if not self.bins[here][s]:
                    del self.bins[here][s]
                self.fill[here] -= s
                self.fill[there] += s
        for there, s, i in moves:
            self.bins[there].setdefault(s, []).append(i)
        for c in (a, b):
            if 0 < self.fill[c] < self.capacity:
                self.enter(c)
            else:
                self.open.discard(c)

    def improve(self, b: int) -> bool:
        """The exchange that fills bin ``b`` most, if any: a move, one for one, one for two, two for one."""
        room, ours = self.capacity - self.fill[b], [(0, 0)]
        ours += [(v, kind) for v in sorted(self.bins[b]) for kind in (0, 1)]
        ours += [(v, 0) for v in sorted(self.sums(b) - self.bins[b].keys())]

        def gain(v: int, kind: int, most: int) -> int:
            """The greatest gain up to ``most`` at which some bin may hold what ``v`` is given for."""
            return (self.has[kind] & ((1 << (v + most + 1)) - 1)).bit_length() - 1 - v

        found = [(-g, kind, v) for v, kind in ours if (g := gain(v, kind, room)) > 0]
        heapify(found)
        while found:
            g, kind, v = heappop(found)
            if (a := self.partner(kind, v - g, b, self.fill[b] - g)) is not None:
                mine = () if not v else (v,) if v in self.bins[b] else self.pair(b, v)
                self.swap(b, mine, a, self.pair(a, v - g) if kind else (v - g,))
                return True
            if (less := gain(v, kind, -g - 1)) > 0:
                heappush(found, (-less, kind, v))
        return False

    def run(self) -> list[list[int]]:
        """Bins of piece numbers, when no exchange helps any more."""
        changed = True
        while changed:
            changed = False
            for b in sorted(self.open, key=lambda b: (-self.fill[b], b)):
                while b in self.open and self.improve(b):
                    changed = True
        return [sorted(i for pieces_ in own.values() for i in pieces_) for own in self.bins if own]


def pack_sizes(sizes: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of piece numbers for ``sizes``."""
    return LocalSearch(sizes, best_fit(sizes, capacity), capacity).run()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, closing: int = CLOSING, with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset; their ids stay out of the shards."""
    cut_up = written(pieces(docs, tokenizer, id_col, text_col, length, closing, with_ids))
    shards = max(1, -(-cut_up.count() // shard))
    light = cut_up.drop("ids")
    names = light.columns

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "shard_key"], kind="stable").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["shard"].iloc[0]) << 32 if len(pdf) else 0
        for b, members in enumerate(pack_sizes(sizes, length)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + b, at
                at += sizes[i]
        return pdf[names].assign(sequence_id=sequence, offset=offset)

    dealt = light.withColumn("shard_key", F.xxhash64("row_id", "piece")).withColumn("shard", F.pmod("shard_key", F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(place, f"{light._jdf.schema().toDDL()}, sequence_id long, offset long")
    if not with_ids:
        return placed
    return cut_up.join(placed.select("row_id", "piece", "sequence_id", "offset"), ["row_id", "piece"]).select(*cut_up.columns, "sequence_id", "offset")
