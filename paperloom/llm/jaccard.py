"""N-gram Jaccard join by several global token orders, and the groups that its links make.

A document is its set of word n-grams. Two documents link if 100 * |both| >= ``PERCENT`` * |either|. Under any
global order of tokens, linked sets share a token among their first n - ceil(n * PERCENT / 100) + 1. Three orders
are used: all put tokens of few sets first, by exact counts over the whole corpus, and shuffle equals by different
hashes.

What one set holds alone can't be common to a pair, and stands first in every order: it takes up the prefix. A set
of n tokens of which e are shared has e - ceil(n * PERCENT / 100) + 1 tokens left in it, and none at all if too few are
shared. Such sets link with nothing and go, in two steps. First all sets look up SAMPLE eighths of their tokens,
by half hashes; most have more tokens alone among these already than a link allows. What is left, one text a set, looks up all its
tokens, which gives their counts among sets that may link. From here on sets are their shared tokens, their size, and their three
prefixes; texts are read no more.

A look-up deals packed rows, what a chunk of texts has in one bucket, by the tokens' hashes. A bucket folds what holds each token, then
answers each row; answers meet again by chunk, where the sets' marks and sizes wait. A token travels once, with its set's
number in the chunk, so its bytes don't depend on how many buckets there are.

Candidates share a prefix token under the first order, pass bounds from their sizes, their shared sizes, the place
of the token and 256-bit parity bitmaps, and must share prefix tokens under the two other orders as well; these
filters are intersected on prefixes alone, and only survivors meet with whole sets.

Equal sets are one entity from the start. The entities of a prefix token are a block; all pairs of a large block are
never made. A turn compares some members (heads) with those of other components, links are closed to
components, and heads leave the block, until each block is one component or used up: what isn't compared is
joined already. The first turn's head is the member with the least tokens of its own, to which near copies of one
original all link. Heads quadruple from turn to turn; small blocks are finished in the second one. So pairs stay in proportion
to rows as long as blocks fall into few components, and none is lost in any case.

Defined cases: null text, or text without a word, has an empty set and links with nothing; fewer words than an
n-gram are one token; rows repeated under one id, with any text, are rows each, and so are rows without an id; a
component's id is its least non-null doc_id; an empty table gives an empty result; texts of any length count whole;
names of further columns can't clash, as they are carried as one struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, freed, written
from paperloom.llm.components import components
from paperloom.llm.shingles import Words, chunks, mix

GRAM, PERCENT = 5, 80
ORDERS = (11, 12, 13)
#: Longs of a set's bitmap, in which each shared token flips one bit: bits that differ are at most the tokens that differ.
BITS = ["s0", "s1", "s2", "s3"]
#: Tokens of a chunk a bucket, and tokens a bucket at most on average.
ROW, BUCKET_TOKENS = 1000, 1_500_000
#: Eighths of the tokens that all sets look up, and all of them.
SAMPLE, ALL = 3, 8
#: Texts of a chunk at most, and bytes of a bucket's rows that stay in memory while it is folded.
CHUNK_TEXTS, HELD = 1 << 16, 1 << 25
#: Blocks of at most SMALL entities make all their pairs in the second turn; others send HEADS, four times as many every turn.
#: All pairs are made as soon as they are at most PAIRS_A_ROW a row of the blocks that are left.
SMALL, HEADS, PAIRS_A_ROW = 16, 8, 16

PACKED = "bucket int, chunk long, sets binary, sizes binary, docs binary, low binary, high binary"
ANSWER = "chunk long, sets binary, sizes binary, docs binary, token binary, df binary"
ENTITY = "f long, n long, e long, tokens binary, first array<long>, second array<int>, third array<int>, " + ", ".join(f"{w} long" for w in BITS)


class Sets:
    """Distinct n-gram hashes of some texts: ``doc`` and ``token`` ascend together."""

    def __init__(self, texts: list[bytes], gram: int):
        words = Words(texts, lower=True)
        n = np.diff(words.offsets)
        grams = words.grams(gram)
        doc = np.repeat(np.arange(len(n)), n)
        whole = (np.arange(len(doc)) - words.offsets[doc])[: len(grams)] + gram <= n[doc[: len(grams)]]
        docs, tokens = [doc[: len(grams)][whole]], [grams[whole]]
        for short in range(1, gram):
            at = np.flatnonzero(n == short)
            if len(at):
                docs.append(at)
                tokens.append(mix(words.grams(short)[words.offsets[at]], 100 + short))
        doc, token = np.concatenate(docs), np.concatenate(tokens)
        order = np.lexsort((token, doc))
        doc, token = doc[order], token[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])])[: len(doc)]
        self.doc, self.token = doc[new], token[new]
        self.sizes = np.bincount(self.doc, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.token, 20))])
        #: Equal sets have equal marks; those of different sets differ but for a chance of 2**-64.
        self.marks = mix(sums[self.starts + self.sizes] - sums[self.starts] + self.sizes.astype(np.uint64), 21).view(np.int64)

    def distinct(self) -> np.ndarray:
        """A mask of the first text with each mark; empty sets are left out."""
        first = np.zeros(len(self.marks), bool)
        first[np.unique(self.marks, return_index=True)[1]] = True
        return first & (self.sizes > 0)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal, neighbouring keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def members_of(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, f) of (doc_id, text): the size and mark of each row's set."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, texts in chunks(batch.column("text")):
                sets, part = Sets(texts, GRAM), batch.slice(first, stop - first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(sets.sizes), pa.array(sets.marks)], ["doc_id", "text_hash", "n", "f"])

    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(freed(run), f"doc_id {kind}, text_hash long, n long, f long")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of PACKED or ANSWER."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), types)], names)


def packed_tokens(rows: DataFrame, buckets: int, share: int = ALL) -> DataFrame:
    """PACKED rows: what a chunk of texts has in one bucket, ``share`` eighths of its tokens, and a row of its different sets.

    Without all tokens only their lower halves are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(1 << 21, max(1 << 18, ROW * buckets * 6 * ALL // share))
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for texts in (texts[i : i + CHUNK_TEXTS] for _, _, texts in chunks(batch.column("text"), size) for i in range(0, len(texts), CHUNK_TEXTS)):
                sets = Sets(texts, GRAM)
                own = sets.distinct()
                if not own.any():
                    continue
                keep = own[sets.doc] & (sets.token & np.uint64(ALL - 1) < np.uint64(share))
                token, doc = sets.token[keep], (np.cumsum(own) - 1)[sets.doc[keep]].astype("<u2")
                high = (token >> np.uint64(32)).astype("<u4")
                bucket = high % np.uint32(buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, doc, low, high = bucket[order], doc[order], token[order].astype("<u4"), high[order]
                cuts = _starts(bucket)
                out = [(chunk % buckets, chunk, sets.marks[own].astype("<i8").tobytes(), sets.sizes[own].astype("<i8").tobytes(), None, None, None)]
                for b, a, z in zip(bucket[cuts].tolist(), cuts, np.append(cuts[1:], len(bucket))):
                    out.append((b, chunk, None, None, doc[a:z].tobytes(), low[a:z].tobytes(), high[a:z].tobytes() if share == ALL else None))
                chunk += 1
                yield _batch(out, PACKED)

    return rows.select("text").mapInArrow(freed(run), PACKED)


class Bucket:
    """For each lower half of a token: a set that holds it, whether another one does, and how often it was counted."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.low, self.mark, self.many, self.count = none.astype("<u4"), none, none.astype(bool), none
        self.parts, self.held = [], 0

    def fold(self, low: np.ndarray, mark: np.ndarray) -> None:
        self.parts.append((low, mark))
        self.held += len(low)
        if self.held > max(500_000, len(self.low)):
            self.close()

    def close(self) -> None:
        if not self.parts:
            return
        low, mark = (np.concatenate([own, *new]) for own, new in zip((self.low, self.mark), zip(*self.parts)))
        many, count = np.zeros(len(low), bool), np.ones(len(low), np.int64)
        many[: len(self.low)], count[: len(self.low)] = self.many, self.count
        order = np.argsort(low, kind="stable")
        low, mark, starts = low[order], mark[order], _starts(low[order])
        differs = mark != np.repeat(mark[starts], np.diff(np.append(starts, len(low))))
        self.low, self.mark = low[starts], mark[starts]
        self.many, self.count = np.logical_or.reduceat(differs | many[order], starts), np.add.reduceat(count[order], starts)
        self.parts, self.held = [], 0

    def shared(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens two sets hold, and how often each of these was counted."""
        at = np.searchsorted(self.low, low)
        hit = self.many[at]
        return hit, self.count[at[hit]]


def _answers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWER rows of one bucket's PACKED ones: shared tokens with their counts, or the sets of the others where tokens are halves."""
    bucket = Bucket()
    with SpooledTemporaryFile(HELD) as file:
        sink = None
        for part in parts:
            sink = sink or pa.ipc.new_stream(file, part.schema)
            sink.write_batch(part)
            for chunk, docs, low in zip(*[part.column(c).to_pylist() for c in ("chunk", "docs", "low")]):
                if low is not None:
                    bucket.fold(np.frombuffer(low, "<u4"), np.frombuffer(docs, "<u2").astype(np.int64) + (chunk << 16))
        sink.close()
        bucket.close()
        file.seek(0)
        for part in pa.ipc.open_stream(file):
            out = []
            for _, chunk, sets, sizes, docs, low, high in zip(*[c.to_pylist() for c in part.columns]):
                if low is None:
                    out.append((chunk, sets, sizes, None, None, None))
                    continue
                docs, low = np.frombuffer(docs, "<u2"), np.frombuffer(low, "<u4")
                hit, df = bucket.shared(low)
                if high is None:
                    found = docs[~hit], None, None
                else:
                    found = docs[hit], np.frombuffer(high, "<u4")[hit].astype("<u8") << np.uint64(32) | low[hit], df.astype("<u4")
                if len(found[0]):
                    out.append((chunk, None, None, *[None if x is None else x.tobytes() for x in found]))
            if out:
                yield _batch(out, ANSWER)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWER rows of PACKED ones that come bucket by bucket."""
    left = (batch.slice(a, z - a) for batch in batches for at in [batch.column("bucket").to_numpy()] for cuts in [_starts(at)] for a, z in zip(cuts, np.append(cuts[1:], len(at))))
    for _, parts in groupby(left, lambda part: part.column("bucket")[0].as_py()):
        yield from _answers(parts)


def look_up(rows: DataFrame, total: int, share: int, judge: Callable, schema: str) -> DataFrame:
    """What ``judge`` makes of each chunk of texts: marks and sizes of its sets, then sets, tokens and counts as its answers have them."""
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total * share // (ALL * BUCKET_TOKENS)))
    dealt = packed_tokens(rows, buckets, share).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        for _, own in groupby(left, lambda row: row[0]):
            columns = [b"".join(x for x in c if x is not None) for c in list(zip(*own))[1:]]
            made = judge(*[np.frombuffer(c, kind) for c, kind in zip(columns, ("<i8", "<i8", "<u2", "<u8", "<u4"))])
            if made is not None:
                yield made

    return written(dealt.mapInArrow(freed(_looked_up), ANSWER).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(freed(run), schema))


def _bitmaps(token: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The BITS of each of the sets that begin at ``starts``."""
    place = mix(token, 30) & np.uint64(64 * len(BITS) - 1)
    bit = np.uint64(1) << (place & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == i, bit, np.uint64(0)), starts).view(np.int64) for i in range(len(BITS))]


def entity_batch(f: np.ndarray, n: np.ndarray, token: np.ndarray, df: np.ndarray, percent: int) -> pa.RecordBatch | None:
    """ENTITY rows of whole sets' shared tokens: those that have a token left in their prefixes."""
    order = np.lexsort((token, f))
    order = order[_starts(f[order], token[order])]
    f, n, token, df = f[order], n[order], token[order], df[order]
    starts = _starts(f)
    e = np.diff(np.append(starts, len(f)))
    head = e + (n[starts] * -percent // 100) + 1
    kept = np.flatnonzero(head > 0)
    if not len(kept):
        return None
    rows = np.repeat(head > 0, e)
    token, df, head, e = token[rows], df[rows], head[kept], e[kept]
    names, sizes, starts = f[starts[kept]], n[starts[kept]], np.cumsum(e) - e
    group = np.repeat(np.arange(len(kept)), e)
    place = np.arange(len(token)) - starts[group]
    bounds, prefixes = pa.array(np.concatenate([[0], np.cumsum(head)]).astype(np.int32)), []
    for seed in ORDERS:
        ordered = token[np.lexsort((mix(token, seed), df, group))][place < head[group]]
        own = ordered.view(np.int64) if seed == ORDERS[0] else ordered.astype("<u4").view(np.int32)
        prefixes.append(pa.ListArray.from_arrays(bounds, pa.array(own)))
    raw, ends = token.astype("<u8"), np.append(starts, len(token))
    tokens = pa.array([raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
    columns = [pa.array(names), pa.array(sizes), pa.array(e), tokens, *prefixes, *[pa.array(w) for w in _bitmaps(token, starts)]]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENTITY.split(", ")])


def may_link(rows: DataFrame, total: int, percent: int) -> DataFrame:
    """The (f) of sets, written, that SAMPLE eighths of their tokens leave: no more are in one text alone than a link allows."""

    def judge(marks: np.ndarray, sizes: np.ndarray, docs: np.ndarray, *_: np.ndarray) -> pa.RecordBatch:
        alone = np.bincount(docs, minlength=len(marks))
        return pa.RecordBatch.from_arrays([pa.array(marks[alone <= sizes + sizes * -percent // 100])], ["f"])

    return look_up(rows, total, SAMPLE, judge, "f long")


def entities(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """ENTITY rows, written: the different sets that may link with another one."""
    left = may_link(rows, members.agg(F.sum("n")).first()[0] or 0, percent)
    leads = written(members.join(left.distinct(), "f").groupBy("f").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n")))
    discard(left)
    texts = rows.select(F.xxhash64("text").alias("text_hash"), "text", F.lit(False).alias("left"))
    both = texts.unionByName(leads.select("text_hash", F.lit(None).cast("string").alias("text"), F.lit(True).alias("left")))
    texts = both.groupBy("text_hash").agg(F.max("text").alias("text"), F.max("left").alias("left")).where("left")
    texts = texts.sortWithinPartitions("text_hash")  # a repeated task makes the same chunks

    def judge(marks: np.ndarray, sizes: np.ndarray, docs: np.ndarray, token: np.ndarray, df: np.ndarray) -> pa.RecordBatch | None:
        return entity_batch(marks[docs], sizes[docs], token, df.astype(np.int64), percent) if len(docs) else None

    found = look_up(texts, leads.agg(F.sum("n")).first()[0] or 0, ALL, judge, ENTITY)
    discard(leads)
    return found


def blocks_of(found: DataFrame) -> DataFrame:
    """(token, f, place, n, e, BITS), written: the entities of each prefix token of the first order that has two or more."""
    rows = found.select(F.posexplode("first").alias("place", "token"), "f", "n", "e", *BITS)
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    return written(rows.join(several, "token").select("token", "f", "place", "n", "e", *BITS))


def _may_link(percent: int) -> Column:
    """Whether what two rows of a block (the second one's names end in _b) tell leaves their sets alike enough."""
    a, b = F.col, lambda c: F.col(f"{c}_b")
    both = a("n") + b("n")
    shared = F.least(a("place"), b("place")) + F.least(a("e") - a("place"), b("e") - b("place"))
    differ = sum((F.bit_count(a(w).bitwiseXOR(b(w))) for w in BITS), both - a("e") - b("e"))
    return (shared * (100 + percent) >= both * percent) & (differ * (100 + percent) <= both * (100 - percent))


def candidates(now: DataFrame, percent: int) -> DataFrame:
    """The different (a, b), of blocks' rows ``now`` with component and head: heads, and members of other components that may link."""
    heads = now.where("head").select("token", *[F.col(c).alias(f"{c}_b") for c in now.columns if c not in ("token", "head")])
    once = ~F.col("head") | (F.col("f") < F.col("f_b"))
    met = now.join(heads, "token").where((F.col("component") != F.col("component_b")) & once & _may_link(percent))
    return met.select(F.least("f", "f_b").alias("a"), F.greatest("f", "f_b").alias("b")).distinct()


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that link: both other orders' prefixes meet, and the whole sets are alike enough."""
    ends = found.select("f", "second", "third")
    near = pairs.join(ends.toDF("a", "second", "third"), "a").join(ends.toDF("b", "second_b", "third_b"), "b")
    near = near.where(F.arrays_overlap("second", "second_b") & F.arrays_overlap("third", "third_b")).select("a", "b")
    sets = found.select("f", "n", "tokens")
    both = near.join(sets.toDF("a", "n", "x"), "a").join(sets.toDF("b", "m", "y"), "b").select("a", "b", (F.col("n") + F.col("m")).alias("n"), "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column("n").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (n - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(freed(run), "a long, b long")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (f, component) after the links (a, b) between entities."""
    ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(ends).toDF("component", "least")
    return written(labels.join(merged, "component", "left").select("f", F.coalesce("least", "component").alias("component")))


def link_groups(found: DataFrame, percent: int) -> DataFrame:
    """(f, component) of the written ENTITY rows ``found``, after all links between them; ``found`` goes."""
    blocks = blocks_of(found)
    labels = written(blocks.select("f").distinct().withColumn("component", F.col("f")))
    turn, block = 0, ["token", "f", "place", "n", "e", *BITS]
    while True:
        now = blocks.join(labels, "f")
        each = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct((F.col("n") - F.col("e")) / F.col("n"), F.col("f"))).alias("own"))
        sizes = each.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.min("own").alias("own"))
        sizes = written(sizes.where("parts > 1").select("token", "rows", "squares", F.col("own.f").alias("centre")))
        rows, pairs = sizes.agg(F.sum("rows"), F.sum((F.col("rows") * F.col("rows") - F.col("squares")) / 2)).first()
        if not rows:
            discard(blocks, sizes, found)
            return labels
        if not turn:
            head = F.col("f") == F.col("centre")
        elif pairs <= PAIRS_A_ROW * rows:
            head = F.lit(True)
        else:
            head = (F.col("rows") <= SMALL) | (F.pmod(F.xxhash64("f", F.lit(turn)), F.col("rows")) < HEADS << 2 * turn)
        now = written(now.join(sizes, "token").select(*block, "component", head.alias("head")))
        pairs = written(candidates(now, percent))
        links = written(verified(pairs, found, percent))
        discard(pairs)
        left = written(now.where("not head").select(*block))
        discard(blocks, sizes, now)
        blocks, turn = left, turn + 1
        if not links.isEmpty():
            labels, old = _relabel(labels, links), labels
            discard(old)
        discard(links)


def groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, component_id, stays) of every row.

    class_id is the least non-null doc_id of the rows with an equal set; stays is true for the first row of a group by
    (doc_id, text_hash).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    members = written(members_of(rows))
    labels = link_groups(entities(rows, members, percent), percent)
    lead = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = members.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("class_id"), lead.alias("lead"))
    classes = written(classes.join(labels, "f", "left").withColumn("component", F.coalesce("component", "f")))
    first = classes.groupBy("component").agg(F.min("class_id").alias("component_id"), F.min("lead").alias("first"))
    named = members.where("n > 0").join(classes.join(first, "component"), "f")
    full = named.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "class_id", "component_id",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"),
    )
    alone = members.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return full.unionByName(alone)


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, the first by (id, text hash); of equal rows one stays."""
    found = groups(docs, percent, id_col, text_col).where("stays").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "n_shingles").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")))
    kept = joined.where("n_shingles > 0").dropDuplicates(["id", "hash"]).unionByName(joined.where("n_shingles = 0"))
    return kept.select("row.*")
