"""Text of laid-out pages from the boxes of their glyphs: blocks, columns, lines and reading order.

Coordinates grow to the right and upwards. A page is cut three times by merging intervals: into blocks by empty bands
across the whole page, a block into columns by empty strips, a column into lines of glyphs that overlap in height. Blocks and lines
are read from the top, columns from the left, and glyphs of a line from the left, with a blank where a gap is wide. Glyphs are shuffled
and sorted once, by page, into arrays a page, one of each number, as these take less when compressed; a task cuts the arrays of some pages at once. So a page is what a task holds at
least; any number of pages is dealt out.

Glyphs without a text or a coordinate are left out; equal boxes are ordered by their text; boxes with their ends exchanged are put right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLYPHS = ("x0", "y0", "x1", "y1", "text")
BOX = ("a", "b", "top", "foot", "text")
LINE = "block long, column long, line long, x0 double, y0 double, x1 double, y1 double, text string"
#: Glyphs of the pages that a task cuts at once, if a page has fewer.
GLYPHS_AT_ONCE = 50_000


def _starts(*keys: np.ndarray) -> np.ndarray:
    """A mask of the rows that differ from the one before; NaN equals NaN."""
    new = np.logical_or.reduce([(k[1:] != k[:-1]) & ((k[1:] == k[1:]) | (k[:-1] == k[:-1])) for k in keys])
    return np.concatenate([[True], new])


def _cut(group: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The interval group of each row: numbered through in the order of ``group``, and from 1 in each group.

    Intervals at most ``gap`` apart belong together. NaN is the greatest number, as it is for Spark.
    """
    order, by_end = np.lexsort((end, start, group)), np.argsort(end)
    place = np.empty(len(end), np.int64)
    place[by_end] = np.arange(len(end))
    own, low = group[order], start[order]
    furthest = np.maximum.accumulate(place[order] + own * len(end)) - own * len(end)
    reach = np.concatenate([[0.0], end[by_end[furthest[:-1]]]])
    first = _starts(own)
    through = np.cumsum(first | (low > reach + gap) | (np.isnan(low) & ~np.isnan(reach))) - 1
    before = np.repeat(through[first], np.diff(np.append(np.flatnonzero(first), len(own))))
    ids, numbers = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    ids[order], numbers[order] = through, through - before + 1
    return ids, numbers


def _lines(page: np.ndarray, box: list[pa.Array], gaps: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """The page of each line in reading order, its numbers and box, and its text."""
    a, b, top, foot = (c.to_numpy(zero_copy_only=False) for c in box[:4])
    block_gap, column_gap, line_gap, word_gap = gaps
    ids, block = _cut(page, top, foot, block_gap)
    ids, column = _cut(ids, a, b, column_gap)
    ids, line = _cut(ids, top, foot, line_gap)
    order = np.lexsort((b, a, ids))
    tied = np.flatnonzero(~_starts(ids[order], a[order], b[order]))
    if len(tied):
        some, rank = order[np.union1d(tied, tied - 1)], np.zeros(len(a), np.int64)
        rank[some] = np.unique(np.array([t.encode() for t in box[4].take(pa.array(some)).to_pylist()], object), return_inverse=True)[1]
        order = np.lexsort((rank, b, a, ids))
    first = _starts(ids[order])
    at = np.flatnonzero(first)
    wide = a[order] - np.concatenate([[0.0], b[order][:-1]])
    blanks = pc.if_else(pa.array(~first & ((wide > word_gap) | np.isnan(wide))), " ", "")
    words = pc.binary_join_element_wise(blanks, box[4].take(pa.array(order)).cast(pa.string()), "")
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), words), "")
    sides = np.fmin.reduceat(a[order], at), -np.maximum.reduceat(foot[order], at), np.maximum.reduceat(b[order], at), -np.fmin.reduceat(top[order], at)
    return page[order][at], [*(c[order][at] for c in (block, column, line)), *sides], texts


def _by_page(glyphs: DataFrame, keys: tuple[str, ...], gaps: tuple[float, ...], whole: bool) -> DataFrame:
    """(keys, LINE) of each line, or (keys, n_lines, text) of each page if ``whole``."""
    some = glyphs.where(" and ".join(f"{c} is not null" for c in GLYPHS))
    left, right, low, high = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    sides = [left.cast("double"), right.cast("double"), (-high).cast("double"), (-low).cast("double"), F.col("text").cast("string")]
    boxes = some.select(F.struct(*keys).alias("key"), *[c.alias(name) for c, name in zip(sides, BOX)])
    pages = boxes.groupBy("key").agg(*[F.collect_list(c).alias(c) for c in BOX])  # none is null, so places agree
    made = "n_lines long, text string" if whole else LINE
    names = ["key", *[c.split()[0] for c in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ends, i = batch.column("key"), batch.column("a").offsets.to_numpy(), 0
            while i < len(key):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + GLYPHS_AT_ONCE, "right")) - 1)
                box = [batch.column(c).values.slice(ends[i], ends[j] - ends[i]) for c in BOX]
                page, numbers, texts = _lines(np.repeat(np.arange(i, j), np.diff(ends[i : j + 1])), box, gaps)
                if whole:
                    at = np.append(np.flatnonzero(_starts(page)), len(page))
                    page, numbers, texts = page[at[:-1]], [np.diff(at)], pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts), "\n")
                yield pa.RecordBatch.from_arrays([key.take(pa.array(page)), *[pa.array(c) for c in numbers], texts], names)
                i = j
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    key_type = pages.schema["key"].dataType.simpleString()
    return pages.mapInArrow(run, f"key {key_type}, {made}").select("key.*", *names[1:])


def lines(glyphs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), block_gap: float = 20.0, column_gap: float = 30.0, line_gap: float = -0.5, word_gap: float = 1.5) -> DataFrame:
    """(keys, block, column, line, x0, y0, x1, y1, text) of (keys, x0, y0, x1, y1, text); gaps are in the pages' units.

    A negative ``line_gap`` lets lines overlap in height by that much and still be apart.
    """
    return _by_page(glyphs, keys, (block_gap, column_gap, line_gap, word_gap), False)


def texts(glyphs: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), block_gap: float = 20.0, column_gap: float = 30.0, line_gap: float = -0.5, word_gap: float = 1.5) -> DataFrame:
    """What :func:`page_texts` makes of :func:`lines`, without a second shuffle."""
    return _by_page(glyphs, keys, (block_gap, column_gap, line_gap, word_gap), True)


def page_texts(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, n_lines, text): the lines of each page in reading order, one a line."""
    listed = F.array_sort(F.collect_list(F.struct("block", "column", "line", "text")))
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(listed, lambda r: r["text"]), "\n").alias("text"))
