"""Passages that repeat, by sparse suffix arrays over content-selected positions.

Of each text only the suffixes at minimisers are retained: in any ``MIN_WORDS`` words one begins early
enough that its first ``PREFIX`` words lie inside. Retained suffixes whose first words recur in another
document are cut from the texts, with the words before them that a window of ``MIN_WORDS`` can
reach. Shards hold all suffixes with the same first words; there they are sorted by their words,
neighbours are compared (the words that they have in common to the right, and, sorted by what goes
before, to the left), and so each match is extended word by word to both sides: windows of
``MIN_WORDS`` words are the same where the common words to the left and to the right add up.
Stretches of such windows are joined to maximal passages. Hashes choose positions and bring
suffixes together; whether passages are the same is decided by their words alone.

A batch sends each context once, with the smallest doc_id that has it; its other places follow that one.
Suffixes that very many documents share (more than ``HOT_GROUP``) are dealt out window by window.

* null and empty texts, texts shorter than ``MIN_WORDS`` words: no passage; very long texts: whole
* repeated rows: rows of one doc_id never repeat one another; alike rows give their spans once
* rows whose doc_id is null: no passage; empty table: no rows; other columns play no part
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.passages import normal_texts, smallest_owners
from concordia.llm.storage import discard, lean, materialize, shuffle_partitions
from concordia.llm.text_kernel import Words, inside_mask, joined_hashes, sliding_argmin, text_array, window_ranges, word_runs

MIN_WORDS = 50
PREFIX = 27
#: Suffixes of one shard key that are sorted together; keys with more are divided further.
HOT_GROUP = 4096
#: Suffixes that are sorted at a time, at about; whole groups.
CHUNK = 8192
#: Bytes of contexts that a batch remembers to send them once.
KNOWN_BYTES = 32 << 20


def retained(words: Words, min_words: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(text, place, first window, windows, anchor) of each retained suffix of a run: its place counts
    words within the text, its windows are those that have it as their minimiser, one after another."""
    h = words.hashes()
    n_windows = max(0, len(h) - min_words + 1)
    lo, hi = window_ranges(words.first, min_words)
    valid = np.flatnonzero(inside_mask(n_windows, lo, np.minimum(hi, n_windows)))
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = joined_hashes(h, prefix)
    at = sliding_argmin(grams, min_words - prefix + 1)[valid]
    of = np.searchsorted(words.first, valid, "right") - 1
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    base = words.first[of[first]]
    return of[first], at[first] - base, valid[first] - base, np.diff(np.append(first, len(valid))), grams[at[first]]


def _places(docs: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """(anchor, doc_id, at): the retained suffixes, named by a hash of their first words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for words in word_runs(text_array(batch)):
                of, at, _, _, anchor = retained(words, min_words, prefix)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(ids[words.rows.start + of]), pa.array(at.astype(np.int32))], ["anchor", "doc_id", "at"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "anchor long, doc_id long, at int")


def _number(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _name(one: int, two: int) -> int:
    return _number(one.to_bytes(8, "little", signed=True) + two.to_bytes(8, "little", signed=True))


_CONTEXT = "shard long, doc_id long, start int, back int, n_windows int, words binary, leader long, leader_start int, row_start int"
_CONTEXT_NAMES = [c.split(" ")[0] for c in _CONTEXT.split(", ")]


def _contexts(texts: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """(shard, doc_id, start, back, n_windows, words, leader, leader_start, row_start): suffixes with what goes before them.

    ``texts`` has doc_id, text and ``places``, structs of at and hot. ``words`` are those that the suffix's
    windows hold, from word ``start``; the suffix begins after ``back`` of them. Where a smaller doc_id of
    the batch has the same, the row only says where, and is dealt out evenly. A hot suffix gives a row for
    each of its windows, which all name the first one's place as ``row_start``.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id").to_numpy(), batch.column("places")
            known: dict[tuple[int, bytes], tuple[int, int]] = {}
            size = 0
            for run_words in word_runs(text_array(batch)):
                of, at, start, count, anchor = retained(run_words, min_words, prefix)
                texts = normal_texts(run_words)
                length = run_words.end - run_words.start + 1
                out: list[tuple] = []
                edges = np.searchsorted(of, np.arange(len(texts) + 1))
                for i, text in enumerate(texts):
                    wanted = places[run_words.rows.start + i].values
                    here = slice(edges[i], edges[i + 1])
                    asked, hot_asked = wanted.field("at").to_numpy(), wanted.field("hot").to_numpy(zero_copy_only=False)
                    keep = np.flatnonzero(np.isin(at[here], asked)) + edges[i]
                    if not len(keep):
                        continue
                    hot = np.isin(at[keep], asked[hot_asked])
                    doc = int(ids[run_words.rows.start + i])
                    byte = np.concatenate([[0], np.cumsum(length[run_words.first[i] : run_words.first[i + 1]])])
                    for j, is_hot in zip(keep.tolist(), hot.tolist(), strict=True):
                        p, s, n, shard = int(at[j]), int(start[j]), int(count[j]), int(anchor[j].view(np.int64))
                        body = text[byte[s] : byte[s + n + min_words - 1] - 1]
                        key = (p - s, body)
                        leader = known.get(key)
                        if leader is not None and leader[0] < doc:
                            out.append((_name(doc, s), doc, s, p - s, n, None, *leader, s))
                            continue
                        if leader is None:
                            size += len(body) + 100
                        known[key] = (doc, s)
                        if not is_hot:
                            out.append((shard, doc, s, p - s, n, body, None, None, s))
                            continue
                        for first in range(s, s + n):
                            one = text[byte[first] : byte[first + min_words] - 1]
                            out.append((_name(shard, _number(one)), doc, first, p - first, 1, one, None, None, s))
                    if size > KNOWN_BYTES:
                        known, size = {}, 0
                if out:
                    columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in columns], _CONTEXT_NAMES)

    return texts.select("doc_id", "text", "places").mapInArrow(run, _CONTEXT)


def _sorted_classes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted by their entries, and how many first entries each shares with the one before."""
    order = np.argsort(np.ascontiguousarray(matrix.astype(">u4")).view(f"V{4 * matrix.shape[1]}").ravel(), kind="stable")
    differ = matrix[order][1:] != matrix[order][:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])


def _repeated_windows(table: pa.Table, min_words: int, prefix: int) -> pa.RecordBatch | None:
    """Runs of windows of suffixes that a smaller doc_id has as well, for whole groups of suffixes."""
    doc, start, back, n, row_start = (table.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "back", "n_windows", "row_start"))
    raw = b" ".join(table.column("words").to_pylist())
    blank = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    offsets = np.concatenate([[0], blank + 1, [len(raw) + 1]])  # each word with the blank after it
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw + b" ")])
    code = np.append(words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, 0)  # 0: no word
    length = n + min_words - 1
    base = np.cumsum(length) - length
    j, left_most = np.arange(min_words), min_words - prefix
    place = (base + back)[:, None] + j
    right = code[np.where(j < (length - back)[:, None], place, len(code) - 1)]
    j = np.arange(1, left_most + 1)
    left = code[np.where(j <= back[:, None], (base + back)[:, None] - j, len(code) - 1)]
    by_right, common_right = _sorted_classes(right)
    by_left, common_left = _sorted_classes(left)
    rows, owners, nth = [], [], []
    one, two = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    for before in range(left_most + 1):  # the window's words before the suffix
        has = np.flatnonzero((before <= back) & (back - before < n))
        if len(has) < 2:
            continue
        one[by_right] = np.cumsum(np.append(0, common_right < min_words - before))
        two[by_left] = np.cumsum(np.append(0, common_left < before))
        key = one[has] * (len(doc) + 1) + two[has]
        order = np.lexsort((doc[has], key))
        new = np.append(True, key[order][1:] != key[order][:-1])
        owner = doc[has][order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        hit = owner < doc[has][order]
        rows.append(has[order][hit])
        owners.append(owner[hit])
        nth.append(back[rows[-1]] - before)
    if not rows or not sum(map(len, rows)):
        return None
    row, owner, nth = (np.concatenate(x) for x in (rows, owners, nth))
    order = np.lexsort((nth, row))
    row, owner, nth = row[order], owner[order], nth[order]
    new = np.append(True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1] + 1))
    b = np.flatnonzero(new)
    count = np.diff(np.append(b, len(row)))
    nothing = pa.nulls(len(b), pa.int64())
    return pa.record_batch([*(pa.array(x) for x in (doc[row[b]], start[row[b]] + nth[b], count, owner[b])), nothing, pa.array(row_start[row[b]]), pa.array(np.zeros(len(b), bool))], _RUN_NAMES)


_RUN = "doc_id long, start long, n_windows long, owner long, owner_start long, row_start long, finished boolean"
_RUN_NAMES = [c.split(" ")[0] for c in _RUN.split(", ")]


def _matches(contexts: DataFrame, min_words: int, prefix: int) -> DataFrame:
    """(doc_id, start, n_windows, owner, owner_start, row_start, finished): runs of windows that a smaller doc_id
    has; those of rows that only name another place are finished, with that place as owner."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            plain = pc.is_valid(batch.column("words"))
            done = batch.filter(pc.invert(plain))
            if done.num_rows:
                columns = [done.column(c).cast(pa.int64()) for c in ("doc_id", "start", "n_windows", "leader", "leader_start", "row_start")]
                yield pa.record_batch([*columns, pa.array(np.ones(done.num_rows, bool))], _RUN_NAMES)
            part = batch.filter(plain)
            if not part.num_rows:
                continue
            held.append(pa.Table.from_batches([part]))
            if sum(t.num_rows for t in held) < CHUNK:
                continue
            table = pa.concat_tables(held).combine_chunks()
            shard = table.column("shard").to_numpy()
            whole = int(np.searchsorted(shard, shard[-1]))  # rows before the group that may go on
            for at in _group_cuts(shard[:whole]):
                if (found := _repeated_windows(table.slice(*at), min_words, prefix)) is not None:
                    yield found
            held = [table.slice(whole)]
        if held:
            table = pa.concat_tables(held).combine_chunks()
            for at in _group_cuts(table.column("shard").to_numpy()):
                if (found := _repeated_windows(table.slice(*at), min_words, prefix)) is not None:
                    yield found

    rows = contexts.repartition(shuffle_partitions(contexts.sparkSession), "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, _RUN)


def _group_cuts(shard: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of parts of about ``CHUNK`` rows that are whole groups."""
    at = 0
    while at < len(shard):
        to = len(shard) if at + CHUNK >= len(shard) else int(np.searchsorted(shard, shard[at + CHUNK], "right"))
        yield at, to - at
        at = to


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id): maximal stretches of words of a document that are covered
    by runs of ``min_words`` words which also occur in a document with a smaller doc_id.

    ``start`` counts words from 0; ``first_doc_id`` is the smallest doc_id that has any of those runs.
    """
    places = materialize(_places(docs, min_words, prefix), "suffix-places")
    groups = places.groupBy("anchor").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"), F.count("*").alias("_n")).where("_low < _high")
    # A table of its own, so that adaptive execution may split the join where an anchor is hot.
    groups = materialize(groups.select("anchor", (F.col("_n") > HOT_GROUP).alias("hot")), "suffix-groups")
    wanted = places.join(groups, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("at", "hot")).alias("places"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    runs = materialize(_matches(_contexts(texts, min_words, prefix), min_words, prefix), "suffix-runs")
    discard(places, groups)
    parts = smallest_owners(runs).select("doc_id", "start", (F.col("n_windows") + min_words - 1).alias("n_words"), F.col("owner").alias("first_doc_id"))
    return extended(parts)


def extended(parts: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a document as one, a stream over sorted rows."""
    names = ["doc_id", "start", "n_words", "first_doc_id"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] | None = None  # doc_id, start, end, first of the stretch that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, n, first = (batch.column(c).to_numpy() for c in range(4))
            out = []
            for d, s, e, f in zip(doc.tolist(), start.tolist(), (start + n).tolist(), first.tolist(), strict=True):
                if last is not None and last[0] == d and s <= last[2]:
                    last[2], last[3] = max(last[2], e), min(last[3], f)
                else:
                    if last is not None:
                        out.append(last)
                    last = [d, s, e, f]
            if out:
                rows = np.array(out, np.int64)
                yield pa.record_batch([pa.array(c) for c in (rows[:, 0], rows[:, 1], rows[:, 2] - rows[:, 1], rows[:, 3])], names)
        if last is not None:
            yield pa.record_batch([pa.array([v], pa.int64()) for v in (last[0], last[1], last[2] - last[1], last[3])], names)

    n = shuffle_partitions(parts.sparkSession)
    return parts.repartition(n, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, "doc_id long, start long, n_words long, first_doc_id long")
