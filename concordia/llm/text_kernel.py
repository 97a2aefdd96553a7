"""Words, shingles and minimisers of whole Arrow batches, by array operations over their bytes.

No Python object is made for a word. Texts are cut into runs of about ``RUN_BYTES`` so that memory
follows the run, or the longest single text, and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2 << 20

#: ASCII white space: blank, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up[:n], cls.down[:n]


@dataclass
class Words:
    """Words of a run of texts. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # bytes of all texts of the run
    start: np.ndarray  # of each word in ``data``
    end: np.ndarray
    first: np.ndarray
    rows: range  # the batch's rows that the run holds

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word, from its bytes and length; with a seed, by a keyed BLAKE2b, a word at a time."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        if seed:
            raw, key, known = self.data.tobytes(), seed.to_bytes(8, "little"), {}
            for word in {raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)}:
                known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
            return np.array([known[raw[a:b]] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)], np.uint64)
        up, down = _Powers.of(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + _U(1)) * up[:-1], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64) * _U(0xA24BAED4963EE407))


def text_array(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column without nulls (they count as empty) and with 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def word_runs(texts: pa.Array, lower: bool = False, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """Cuts a column of texts into runs and finds the words `[^\\x20\\x09-\\x0D]+` of each."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        edges = offsets[at : to + 1] - offsets[at]
        yield _words(_LOWER[part] if lower else part, edges, range(at, to))
        at = to


def _words(data: np.ndarray, edges: np.ndarray, rows: range) -> Words:
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[edges[:-1][edges[:-1] < len(data)]] = False
        ends = edges[1:]
        after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, edges), rows)


def joined_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive entries; the caller drops those that cross a text's edge."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = words[:n].copy()
    for j in range(1, k):
        total *= _WORD_STEP
        total += words[j : j + n]
    return mix(total)


def window_ranges(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, where its windows of k words start and end in the words of the run."""
    return first[:-1], np.maximum(first[:-1], first[1:] - (k - 1))


def inside_mask(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True at each place that lies in one of the disjoint ranges [lo, hi)."""
    step = np.zeros(n + 1, np.int32)
    keep = hi > lo
    np.add.at(step, lo[keep], 1)
    np.add.at(step, hi[keep], -1)
    return np.cumsum(step[:-1]) > 0


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the smallest of values[i:i + width]; of equal ones the leftmost."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = values[:n].copy()
    at = np.arange(n)
    for j in range(1, width):
        other = values[j : j + n]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    return at
