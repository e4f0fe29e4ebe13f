"""Words and word n-grams of many texts at once, as 64-bit hashes.

A word is read in blocks of eight bytes, the hash so far and the block are scrambled together, its length last; all
words of a batch take their next block at once. An n-gram hash mixes the hashes of its words with their places. The steps aren't
linear in the bytes, so no structure of words makes collisions likelier than about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROWS = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text hashed at once.
CHUNK = 1 << 19


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def _hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word of ``raw``."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    sizes = ends - starts
    hashes = np.zeros(len(starts), np.uint64)
    at, rows = starts, slice(None)
    left = sizes
    while len(left):
        kept = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        hashes[rows] = mix(hashes[rows] ^ (blocks[at] & kept), 1)
        more = left > 8
        rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(hashes + sizes.astype(np.uint64), 3)


class Words:
    """The words of some texts: hash of each, and where each text's words begin."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        if lower:
            raw = _LOWER[raw]
        space = _SPACE[raw]
        edges = np.diff(np.concatenate([[True], space]).view(np.int8))
        self.starts = np.flatnonzero(edges == -1)
        self.ends = np.flatnonzero(edges == 1)
        self.hashes = _hashed(raw, self.starts, self.ends)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begins = np.concatenate([[0], np.cumsum(sizes)])
        #: Words of text i are offsets[i] to offsets[i + 1].
        self.offsets = np.searchsorted(self.starts, begins)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on; what crosses into another text is not to be used."""
        count = max(0, len(self.hashes) - n + 1)
        total = np.zeros(count, np.uint64)
        for j in range(n):
            total += self.hashes[j : j + count] * _ROWS[j]
        return mix(total, 2)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, stop, texts in UTF-8) of consecutive rows of about ``size`` bytes; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    first, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= size or i + 1 == len(sizes):
            texts = column.slice(first, i + 1 - first).cast(pa.large_binary()).to_pylist()
            yield first, i + 1, [t or b"" for t in texts]
            first, held = i + 1, 0
