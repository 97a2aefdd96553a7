"""Where passages recur, found by minimiser anchors; shared by the operators on repeated text.

A window of ``window`` words is anchored at its smallest ``k``-gram by hash, so equal windows anywhere
share an anchor, and neighbouring windows mostly share one too. Rows carry an anchor with short
hashes of the windows it anchors: they are all that is shuffled, once, and singletons end there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.storage import lean, materialize, shuffle_partitions
from concordia.llm.text_kernel import Words, inside_mask, joined_hashes, mix, sliding_argmin, text_array, window_ranges, word_runs

_U = np.uint64


def sequence_digests(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words and a 128-bit digest of each text's word sequence."""
    n = np.diff(words.first)
    place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], n)).astype(np.uint64)
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    some = n > 0
    if len(hashes):
        starts = words.first[:-1][some]
        one[some] = np.add.reduceat(mix(hashes + place * _U(0x9E3779B97F4A7C15)), starts)
        two[some] = np.add.reduceat(mix((hashes ^ _U(0x5851F42D4C957F2D)) + place * _U(0xD1342543DE82EF95)), starts)
    return n, one, two


def word_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): rows whose word sequence also belongs to a smaller doc_id. The digest is the SHA-256
    of the words with a blank between, so a doc_id that has several texts is a copy in one of them only."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_runs(text_array(batch)):
                some = np.flatnonzero(np.diff(words.first) > 0)
                texts = normal_texts(words)
                digests = pa.array([hashlib.sha256(texts[i]).digest() for i in some.tolist()], pa.binary())
                yield pa.record_batch([batch.column(0).take(pa.array(some + words.rows.start)), digests], ["doc_id", "digest"])

    texts = materialize(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, digest binary"), "word-digests")
    reps = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_top")).where("rep < _top")
    return texts.join(reps, "digest").where("doc_id > rep").select("doc_id", "digest").distinct()


#: Bytes of a window's hash. Windows are told apart under one anchor only, whose hash has 64 bits of its own.
WIDTH = 6
#: So many rows of one anchor in a run of texts are combined before they leave the batch.
HOT_IN_RUN = 4
_ROW = "anchor long, doc_id long, start int, windows binary, more binary, n_windows int, owner long, owner_start int"
_NAMES = [c.split(" ")[0] for c in _ROW.split(", ")]


class _Combiner:
    """Pre-aggregates the rows of anchors that are frequent in a batch.

    What a smaller doc_id of the batch has already shown is known to recur: such a row becomes a
    finished run, dealt out evenly instead of by its anchor. Places where a document repeats its
    own windows are listed in its first row. So a passage that a third of all documents share
    sends a few rows a batch to its anchor's task.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        self.hot = np.zeros(0, np.uint64)

    def combine(self, run: int, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, edges: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        value, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
        fresh = value[count >= HOT_IN_RUN]
        self.hot = np.union1d(self.hot, fresh)
        keep, more = np.ones(len(anchor), bool), {}
        finished: list[tuple[int, int]] = []
        for i in np.flatnonzero(np.isin(value, self.hot)[place]):
            key = (int(anchor[i]), hashes[edges[i] : edges[i + 1]].tobytes())
            first = self.known.get(key)
            if first is not None and first[0] < doc[i]:
                finished.append((i, key))
                keep[i] = False
            elif first is not None and first[0] == doc[i] and first[3] == run:
                more.setdefault(first[2], []).append(int(start[i]))
                keep[i] = False
            else:
                self.known[key] = (int(doc[i]), int(start[i]), int(i), run)
        row = np.flatnonzero(keep)
        values = pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer((edges * hashes.shape[1]).astype(np.int32)), pa.py_buffer(hashes)]).take(pa.array(row))
        others = pa.array([np.array(more[i], "<i4").tobytes() if i in more else None for i in row.tolist()] if more else [None] * len(row), pa.binary())
        none = np.zeros(len(row), np.int64)
        plain = [pa.array(anchor[row].view(np.int64)), pa.array(doc[row]), pa.array(start[row].astype(np.int32)), values, others, pa.array(none.astype(np.int32)), pa.array(none), pa.array(none.astype(np.int32))]
        if not finished:
            return pa.record_batch(plain, _NAMES)
        at = np.array([i for i, _ in finished])
        dealt = mix(doc[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + start[at].astype(np.uint64))
        owner = np.array([self.known[k][:2] for _, k in finished], np.int64)
        nothing = pa.nulls(len(at), pa.binary())
        done = [pa.array(dealt.view(np.int64)), pa.array(doc[at]), pa.array(start[at].astype(np.int32)), nothing, nothing, pa.array((edges[at + 1] - edges[at]).astype(np.int32)), pa.array(owner[:, 0]), pa.array(owner[:, 1].astype(np.int32))]
        return pa.record_batch([pa.concat_arrays([x, y]) for x, y in zip(plain, done, strict=True)], _NAMES)


def _same_words(one: bytes, two: bytes) -> bool:
    return one == two or one.split() == two.split()  # bytes split at the blanks that part words here


def anchor_rows(docs: DataFrame, window: int, k: int, width: int = WIDTH) -> DataFrame:
    """(anchor, doc_id, start, windows, more, n_windows, owner, owner_start): ``windows`` has ``width`` bytes
    of hash for each window from word ``start``; ``more`` has other places of the document with the same
    windows. Rows with ``n_windows`` are finished runs, see ``_Combiner``.

    Within a batch, a text whose words a smaller doc_id has given already is passed over: it is a
    copy, and its words are known from the smaller one. Digests find it, its words confirm it.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            seen: dict[tuple[int, int], tuple[int, int]] = {}
            combiner, texts = _Combiner(), text_array(batch)
            raw = lambda i: texts[i].as_buffer().to_pybytes()
            for number, words in enumerate(word_runs(texts)):
                h = words.hashes()
                n, one, two = sequence_digests(words, h)
                own = ids[words.rows.start : words.rows.stop]
                fresh = n >= window
                for i in np.flatnonzero(fresh):
                    key = (int(one[i]), int(two[i]))
                    first = seen.get(key)
                    row = words.rows.start + int(i)
                    if first is not None and first[0] < own[i] and _same_words(raw(first[1]), raw(row)):
                        fresh[i] = False
                    elif first is None or own[i] < first[0]:
                        seen[key] = (int(own[i]), row)
                lo, hi = window_ranges(words.first, window)
                whole, grams = joined_hashes(h, window), joined_hashes(h, k)
                at = sliding_argmin(grams, window - k + 1)
                valid = np.flatnonzero(inside_mask(len(whole), np.where(fresh, lo, 0), np.where(fresh, hi, 0)))
                if not len(valid):
                    continue
                of = np.searchsorted(words.first, valid, "right") - 1
                new = np.ones(len(valid), bool)
                new[1:] = (at[valid][1:] != at[valid][:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(new)
                start = (valid - words.first[of])[first]
                short = np.ascontiguousarray(whole[valid].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
                yield combiner.combine(number, grams[at[valid[first]]], own[of[first]], start, np.append(first, len(valid)), short)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, _ROW)


def recurring_runs(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, start, n_windows, owner, owner_start, row_start, finished): runs of windows that a smaller
    doc_id has too. The owner is the smallest one that has them or, in a finished run, the one that
    its batch knew: ``smallest_owners`` looks further. ``rows`` come from ``anchor_rows`` of this ``width``.

    One exchange by anchor; each partition is sorted and read as a stream. Of the group in which
    a batch ends, only the owners of its distinct windows are kept, not its rows.
    """
    names = ["doc_id", "start", "n_windows", "owner", "owner_start", "row_start", "finished"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_anchor, owners = None, {}
        for whole in batches:
            finished = pc.greater(whole.column("n_windows"), 0)
            done = whole.filter(finished)
            if done.num_rows:
                yield pa.record_batch([done.column(c).cast(pa.int64()) for c in (*names[:5], "start")] + [pa.array(np.ones(done.num_rows, bool))], names)
            batch = whole.filter(pc.invert(finished))
            if not batch.num_rows:
                continue
            anchor, doc, start = (batch.column(c).to_numpy() for c in range(3))
            edges = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(3)).to_numpy())])
            same = anchor[1:] == anchor[:-1]
            many = np.zeros(len(anchor), bool)
            many[1:] |= same
            many[:-1] |= same
            many |= (anchor == anchor[-1]) | (anchor == open_anchor if open_anchor is not None else False)
            row = np.flatnonzero(many)
            count = (edges[1:] - edges[:-1])[row] // width
            of = np.repeat(row, count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            wide = np.zeros((len(of), 8), np.uint8)
            wide[:, :width] = np.frombuffer(b"".join(v.as_buffer() for v in batch.column(3).take(pa.array(row))), np.uint8).reshape(-1, width)
            short = wide.view("<u8")[:, 0]
            a, d, p = anchor[of], doc[of], start[of].astype(np.int64) + nth
            order = np.lexsort((short, a))
            first = np.ones(len(order), bool)
            first[1:] = (a[order][1:] != a[order][:-1]) | (short[order][1:] != short[order][:-1])
            lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            owner, place = np.empty_like(d), np.empty_like(p)
            owner[order], place[order] = d[lead], p[lead]
            if open_anchor is not None and anchor[0] == open_anchor:
                for i in np.flatnonzero(a == open_anchor):
                    if (known := owners.get(int(short[i]))) is not None:
                        owner[i], place[i] = known
            if anchor[-1] != open_anchor:
                open_anchor, owners = anchor[-1], {}
            for i in np.flatnonzero(a == open_anchor):
                owners.setdefault(int(short[i]), (owner[i], place[i]))
            hit = np.flatnonzero(owner < d)
            if not len(hit):
                continue
            new = np.ones(len(hit), bool)
            x, y = hit[1:], hit[:-1]
            new[1:] = (of[x] != of[y]) | (x != y + 1) | (owner[x] != owner[y]) | (place[x] != place[y] + 1)
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(hit)))
            b = hit[begin]
            at = start[of[b]].astype(np.int64)
            yield pa.record_batch([pa.array(c) for c in (d[b], p[b], size, owner[b], place[b], at, np.zeros(len(b), bool))], names)
            # The same runs at the document's other places with these windows.
            again = []
            for j in np.flatnonzero(pc.is_valid(batch.column("more")).to_numpy(zero_copy_only=False)[of[b]]):
                r = of[b[j]]
                for other in np.frombuffer(batch.column("more")[int(r)].as_buffer(), "<i4"):
                    again.append((d[b[j]], p[b[j]] - start[r] + other, size[j], owner[b[j]], place[b[j]], other))
            if again:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*again, strict=True)] + [pa.array(np.zeros(len(again), bool))], names)

    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(run, "doc_id long, start long, n_windows long, owner long, owner_start long, row_start long, finished boolean")


def smallest_owners(runs: DataFrame) -> DataFrame:
    """(doc_id, start, n_windows, owner): finished runs take the smallest owner of the row they were known from."""
    first = runs.where("not finished").groupBy(F.col("doc_id").alias("_d"), F.col("row_start").alias("_s")).agg(F.min("owner").alias("_first"))
    done = runs.where("finished").join(first, (F.col("owner") == F.col("_d")) & (F.col("owner_start") == F.col("_s")), "left")
    done = done.select("doc_id", "start", "n_windows", F.least("owner", "_first").alias("owner"))
    return runs.where("not finished").select("doc_id", "start", "n_windows", "owner").unionByName(done)


def joined_runs(runs: DataFrame) -> DataFrame:
    """Runs of a document that go on from one another, in it and in the owner, as one."""
    names = ["doc_id", "start", "n_windows", "owner", "owner_start"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, n, owner, place = (batch.column(c).to_numpy() for c in range(5))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + n[:-1])
            b = np.flatnonzero(new)
            yield pa.record_batch([pa.array(x) for x in (doc[b], start[b], np.add.reduceat(n, b), owner[b], place[b])], names)

    p = shuffle_partitions(runs.sparkSession)
    runs = runs.select(names)
    return runs.repartition(p, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, runs.schema)


def normal_texts(words: Words) -> list[bytes]:
    """Each text's words with one blank between."""
    if not len(words.start):
        return [b""] * len(words.rows)
    keep = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(keep, words.start, 1)
    np.add.at(keep, words.end, -1)
    mask = np.cumsum(keep[:-1]) > 0
    last = words.first[1:][np.diff(words.first) > 0] - 1
    gap = np.delete(words.end, last)
    data = words.data.copy()
    data[gap] = 32
    mask[gap] = True
    size = np.concatenate([[0], np.cumsum(words.end - words.start)]) + np.arange(len(words.start) + 1)
    raw = data[mask].tobytes()
    # Between texts there is no blank: each non-empty text ends one byte earlier.
    texts, at = [], 0
    for i in range(len(words.rows)):
        lo, hi = words.first[i], words.first[i + 1]
        n = int(size[hi] - size[lo]) - 1 if hi > lo else 0
        texts.append(raw[at : at + n])
        at += n
    return texts


def packed_texts(docs: DataFrame, keep: str = "doc_id") -> DataFrame:
    """(doc_id, packed): normal texts, compressed before they are shuffled."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True)
        for batch in batches:
            for words in word_runs(text_array(batch)):
                packed = [press.compress(t) for t in normal_texts(words)]
                yield pa.record_batch([batch.column(0).slice(words.rows.start, len(packed)), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)
