"""Token ids of whole texts by a public tokenizer, a batch at a time.

The tokenizers used here never join text across a blank or line end that is followed by a
visible character, nor a letter or digit with punctuation after it (an apostrophe apart), so a
text is the concatenation of the pieces cut before those, and so are its ids. What follows a byte
is looked up inside its own text only; a text that holds an added token of the vocabulary (an end
marker, say) is one piece, so the marker gets its own id as in a plain call of the library.

Each distinct piece of a run is encoded once by the library. Pieces that recur are remembered by
the worker, up to ``REMEMBERED_BYTES``; new ones are mostly encoded many at a time, end to end.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What a worker's memory of pieces may take, about; beyond that only pieces of several runs stay.
REMEMBERED_BYTES = 48 << 20
#: Bytes that a remembered piece takes besides its text and ids.
_PER_PIECE = 200
RUN_BYTES = 4 << 20
#: Bytes that one call of the library gets, unless one piece is longer.
CALL_BYTES = 1 << 18

#: A byte that may follow a cut: visible ASCII, or the first byte of U+00C0 to U+07FF (none is white space).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_VISIBLE[0xC3:0xE0] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b'!"#$%&()*+,-./:;<=>?@[]^_`{|}~')] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """``tokenizers`` over one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.markers = [t.encode() for t in sorted(added) if t]
        suffix = self.tokenizer.model.end_of_word_suffix or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: bytes of text for each id: a character of a byte-level vocabulary stands for one byte
        self.size = np.zeros(1 + max(vocabulary.values()), np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self.keeps_blanks = int(self.size[self._ids(" a")].sum()) == 2
        self.folds = self.tokenizer.normalizer is not None  # non-ASCII bytes may change their number
        self.forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.runs = np.zeros(1 << 12, np.int64)  # in how many runs a piece has been
        self.pool = np.zeros(1 << 14, np.uint32)
        self.used = self.text_bytes = 0

    def _add(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.known), len(pieces)
        if n + m > len(self.start):
            size = max(2 * len(self.start), n + m)
            self.start, self.count, self.runs = (np.concatenate([a, np.zeros(size - len(a), np.int64)]) for a in (self.start, self.count, self.runs))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), self.used + len(flat) - len(self.pool)), np.uint32)])
        self.start[n : n + m] = self.used + np.cumsum(counts) - counts
        self.count[n : n + m] = counts
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.text_bytes += sum(map(len, pieces))
        self.known.update(zip(pieces, range(n, n + m), strict=True))

    def _one_by_one(self, pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(pieces, np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())), counts)

    def _together(self, pieces: list[str], sizes: np.ndarray) -> None:
        """Pieces that may follow one another in a text, in one call; their ids are told apart by bytes."""
        flat = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        if not len(flat) or flat.max() >= len(self.size):  # nothing, or an added token
            return self._one_by_one(pieces)
        reached, ends = np.cumsum(self.size[flat]), np.cumsum(sizes)
        at = np.searchsorted(reached, ends)
        if reached[-1] != ends[-1] or (reached[at] != ends).any():
            return self._one_by_one(pieces)
        self._add(pieces, flat, np.diff(at + 1, prepend=0))

    def _learn(self, new: pa.Array) -> None:
        """Encodes distinct pieces (large_string). Those that begin with a blank or line end and a visible
        character may follow any piece; the rest is encoded one by one."""
        offsets = np.frombuffer(new.buffers()[1], np.int64, len(new) + 1, new.offset * 8)
        data = np.frombuffer(new.buffers()[2], np.uint8)
        first = offsets[:-1]
        size = np.diff(offsets)
        free = (size > 1) & ((data[first] == 32) | (data[first] == 10)) & _VISIBLE[data[np.minimum(first + 1, len(data) - 1)]]
        weight = size.copy()
        if not self.keeps_blanks:
            blanks = np.concatenate([[0], np.cumsum(_BLANK[data[offsets[0] : offsets[-1]]])])
            weight -= np.diff(blanks[offsets - offsets[0]])
        if self.folds:
            high = np.concatenate([[0], np.cumsum(data[offsets[0] : offsets[-1]] > 127)])
            free &= np.diff(high[offsets - offsets[0]]) == 0
        for rows, learn in ((np.flatnonzero(free), True), (np.flatnonzero(~free), False)):
            pieces, call = new.take(pa.array(rows)).to_pylist(), np.cumsum(size[rows]) // CALL_BYTES
            edges = np.flatnonzero(np.diff(call, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if learn:
                    self._together(pieces[lo:hi], weight[rows[lo:hi]])
                else:
                    self._one_by_one(pieces[lo:hi])

    def _shrink(self) -> None:
        """Keeps the pieces that have been in several runs, or none where these are too many as well."""
        old, start, count, runs, pool = self.known, self.start, self.count, self.runs, self.pool
        stay = [(p, i) for p, i in old.items() if runs[i] > 1]
        self.forget()
        if sum(len(p) + _PER_PIECE for p, _ in stay) + 4 * int(count[[i for _, i in stay]].sum() if stay else 0) > REMEMBERED_BYTES // 2:
            return
        if stay:
            of = np.array([i for _, i in stay])
            counts = count[of]
            at = np.repeat(start[of] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            self._add([p for p, _ in stay], pool[at], counts)
            self.runs[: len(of)] = 1

    def _cuts(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end."""
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == 32) | (data == 10)
        cut[:-2] &= _VISIBLE[data[1:]]
        cut[np.maximum(edges[1:] - 1, 0)] = False  # what follows a text's last byte is another text
        cut[1:-1] |= _POINT[data[1:]] & _ALNUM[data[:-1]]
        raw = data.tobytes()
        for marker in self.markers:
            at = raw.find(marker)
            while at >= 0:
                i = int(np.searchsorted(edges, at, "right")) - 1
                cut[edges[i] : edges[i + 1]] = False
                at = raw.find(marker, int(edges[i + 1]))
        cut[edges] = True
        cut[0] = cut[-1] = True
        return np.flatnonzero(cut)

    def run(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end in ``data``, and where each text's ids begin and end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        offsets = self._cuts(data, edges)
        pieces = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        if new := [i for i, w in enumerate(words) if w not in known]:
            self._learn(coded.dictionary.take(pa.array(new)))
        of = np.fromiter((known[w] for w in words), np.int64, len(words))
        self.runs[of] += 1
        place = of[coded.indices.to_numpy()]
        count = self.count[place]
        ends = np.cumsum(count)
        at = np.repeat(self.start[place] - (ends - count), count) + np.arange(int(ends[-1]))
        bounds = np.concatenate([[0], ends])[np.searchsorted(offsets, edges)]
        ids = self.pool[at]
        if len(known) * _PER_PIECE + self.text_bytes + 4 * self.used > REMEMBERED_BYTES:
            self._shrink()
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_runs(texts: pa.Array, path: str) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) for runs of a large_string column without nulls."""
    coder, n = encoder(path), len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, "right")) - 1)
        yield range(at, to), *coder.run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each text."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = bounds[1:] + np.arange(n)
    out[ends] = end
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = ids
    return out, bounds + np.arange(n + 1)
