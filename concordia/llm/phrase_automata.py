"""Repeated-phrase automata: recurring passages are confirmed in their owner's text, compiled into
Aho-Corasick automata, one for each shard of documents, and every document is streamed through
its shard's automaton to find each place where a passage of a smaller document occurs.

A passage reaches only the shards in which anchors place it, and the number of shards follows the
words of all passages asked for, so an automaton holds about ``SHARD_WORDS`` of them at most.
Texts that are copies as a whole are found by the SHA-256 of their words and need no passage.

* null and empty texts, texts without a word: no words, nothing removed, the empty text's digest
* texts shorter than a window: nothing removed; very long texts: whole
* repeated rows: rows of one doc_id never remove from one another, also if their texts differ;
  each row gets its row of the result
* rows whose doc_id is null: neither remove nor lose words
* empty table: no rows; other columns of the input play no part
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.passages import anchor_rows, joined_runs, packed_texts, recurring_runs, unpacked, word_copies
from concordia.llm.storage import lean, materialize, shuffle_partitions

WINDOW = 13
ANCHOR = 6
#: Words of passages that a shard's automaton holds, about.
SHARD_WORDS = 250_000


def _phrases(requests: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(shard, kind, doc_id, body, n): owners' passages as text, cut where the requests say."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for owner, shard, wanted, packed in zip(*(batch.column(c) for c in ("owner", "shard", "wanted", "packed")), strict=True):
                words = unpacked(packed.as_buffer().to_pybytes()).split(b" ")
                for w in wanted.as_py():
                    phrase = words[w["owner_start"] : w["owner_start"] + w["n_windows"] + window - 1]
                    if len(phrase) >= window:
                        rows.append((shard.as_py(), 0, owner.as_py(), b" ".join(phrase), len(phrase)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["shard", "kind", "doc_id", "body", "n"])

    wanted = requests.groupBy("owner", "shard").agg(F.collect_set(F.struct("owner_start", "n_windows")).alias("wanted"))
    both = wanted.join(texts.withColumnRenamed("doc_id", "owner"), "owner").select("owner", "shard", "wanted", "packed")
    return both.mapInArrow(run, "shard int, kind int, doc_id long, body binary, n long")


class Automaton:
    """Passages of a shard with their owners; finds the words of a text that smaller documents have."""

    def __init__(self) -> None:
        self.trie, self.copies, self.ready = ahocorasick.Automaton(), set(), False

    def add(self, phrase: bytes, owner: int, n_words: int) -> None:
        key = f" {phrase.decode()} "
        known = self.trie.get(key, None)
        if known is None or owner < known[0]:
            self.trie.add_word(key, (owner, n_words, len(key)))

    def covered(self, doc_id: int | None, text: str, n_words: int) -> np.ndarray:
        """Of each word, whether a passage of a smaller doc_id covers it."""
        hit = np.zeros(n_words + 1, np.int32)
        if doc_id is None or not n_words or not len(self.trie):
            return hit[:-1] > 0
        if not self.ready:
            self.trie.make_automaton()
            self.ready = True
        hay, blanks = f" {text} ", None
        for end, (owner, n, size) in self.trie.iter(hay):
            if owner < doc_id:
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(hay.encode("utf-32-le"), np.uint32) == 32)
                at = int(np.searchsorted(blanks, end - size + 1))
                hit[at] += 1
                hit[at + n] -= 1
        return np.cumsum(hit[:-1]) > 0


def _streamed(rows: DataFrame, window: int) -> DataFrame:
    """Builds each shard's automaton from its first rows and streams its documents through it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, found = None, Automaton()
        for whole in batches:
            out = []
            for of, kind, doc_id, body, n in zip(*(whole.column(c) for c in range(5)), strict=True):
                of, kind, doc_id = of.as_py(), kind.as_py(), doc_id.as_py()
                if of != shard:
                    shard, found = of, Automaton()
                if kind == 0:
                    if n.as_py():
                        found.add(body.as_py(), doc_id, n.as_py())
                    else:
                        found.copies.add((doc_id, body.as_py()))
                    continue
                text = unpacked(body.as_buffer().to_pybytes())
                words = text.split(b" ") if text else []
                if len(words) >= window and found.copies and (doc_id, hashlib.sha256(text).digest()) in found.copies:
                    gone = np.ones(len(words), bool)
                else:
                    gone = found.covered(doc_id, text.decode(), len(words))
                removed = int(gone.sum())
                left = text if not removed else b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.append((doc_id, len(words), removed, left))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "kind", "doc_id")
    return ordered.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words that a window of ``window`` words
    covers which also starts in a document with a smaller doc_id; kept words joined by a blank."""
    runs = materialize(joined_runs(recurring_runs(anchor_rows(docs, window, ANCHOR))), "runs")
    asked = int(runs.agg(F.sum(F.col("n_windows") + window - 1)).head()[0] or 0)
    shards = max(4 * shuffle_partitions(docs.sparkSession), -(-asked // SHARD_WORDS))
    shard = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(shards)), F.lit(0)).cast("int").alias("shard")
    requests = runs.select("owner", "owner_start", "n_windows", shard)
    texts = packed_texts(docs)
    phrases = _phrases(requests, texts, window)
    whole = word_copies(docs).select(shard, F.lit(0).alias("kind"), "doc_id", F.col("digest").alias("body"), F.lit(0).cast("long").alias("n"))
    streams = texts.select(shard, F.lit(1).alias("kind"), "doc_id", F.col("packed").alias("body"), F.lit(0).cast("long").alias("n"))
    return _streamed(phrases.unionByName(whole).unionByName(streams), window)


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return remove_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
