"""Words and word shingles of Arrow text columns as numpy arrays of 64-bit hashes, half a megabyte at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 19


@dataclass
class Words:
    """The words of some texts: lower-cased bytes of all texts, and each word's place, text number and hash."""

    data: np.ndarray
    text_at: np.ndarray  # where each text starts in data; one more than there are texts
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # number of each text's first word; one more than there are texts
    hash: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    def __init__(self) -> None:
        self.n = 0
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def __call__(self, texts: pa.Array, lower: bool = True) -> Words:
        """texts: a string array without nulls."""
        at = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        n = len(data)
        if lower:
            data = self.lower[data]
        word = ~self.space[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        edge = at[(at > 0) & (at < n)]
        before[edge] = False
        after[edge - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        first = np.searchsorted(start, at)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        if self.n < n + 1:
            self.n = max(n + 1, SLICE_BYTES * 2)
            self.up, self.down = powers(BASE, self.n), powers(BASE_INVERSE, self.n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        h = (total[end] - total[start]) * self.down[start]
        return Words(data, at, start, end, text, first, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


MULTIPLIERS = [pow(0xA0761D6478BD642F, 2 * j + 1, 1 << 64) | 1 for j in range(16)]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): every word shingle of each text in order, repeats included, and where each text's shingles start.

    A text of fewer words has its whole sequence as its one shingle, a text without words none.
    """
    counts = np.diff(w.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(first[-1], np.uint64)
    starts = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
    length = np.repeat(np.minimum(counts, size), n)
    for j in range(size):
        ok = length > j
        out[ok] += w.hash[starts[ok] + j] * np.uint64(MULTIPLIERS[j])
    return mix(out + length.astype(np.uint64)), first


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row ranges of at most `most` bytes of text (single texts may be longer), with the text column, nulls as empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to
