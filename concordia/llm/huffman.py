"""Token ids in binary blocks under a canonical, length-limited Huffman code.

Ids are counted over all documents; package-merge gives the best code lengths up to ``MAX_BITS``, and
canonical codes follow from the lengths alone, so the codebook is one byte a symbol. Each document's
bits begin at a byte; every ``STRIDE`` symbols a checkpoint says at which bit to go on. A block holds
whole documents with their ids, lengths, checkpoints and bits, and decodes by itself: all
stretches between checkpoints advance together, one table look-up a symbol.

Blocks are stored in ascending doc_id order, in shards (doc_id ranges), as binary values of a Parquet
table in the shared folder.

* null and empty texts: the end id alone
* very long texts: one document never spans blocks; a block grows to hold it
* repeated rows: each is stored, next to the other; rows whose doc_id is null come last, in blocks of
  their own that say so
* more than 2 ** ``MAX_BITS`` distinct ids: codes get as many bits as these need
* empty table: no blocks, no rows
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm import tokens
from concordia.llm.storage import TEXT_ROWS, lean, materialize, shuffle_partitions
from concordia.llm.text_kernel import text_array

MAX_BITS = 16
STRIDE = 256
BLOCK_TOKENS = 1 << 18
END_ID = 0
#: A block opens with these bytes, then documents, symbols, stride, bytes of bits and flags.
MAGIC = b"CHUF"
HEAD = struct.Struct("<4sIIIII")
#: The flag of a block whose documents have no doc_id.
NAMELESS = 1


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: optimal code lengths of at most ``limit`` bits; 0 where nothing was counted."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length())
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[symbols].astype(np.int64)
    merged, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(order < n)
    bits, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        of_leaves = int(is_leaf[:take].sum())
        bits[:of_leaves] += 1
        take = 2 * (take - of_leaves)
    lengths[symbols] = bits
    return lengths


class Code:
    """A canonical code: shorter codes first, by symbol within a length."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        self.width = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = np.left_shift(np.int64(1), self.width - lengths[order].astype(np.int64))
        first = np.cumsum(span) - span  # codes, filled up to the full width
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.width - lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol_at = np.zeros(1 << self.width, np.uint32)
        self.length_at = np.ones(1 << self.width, np.uint8)
        used = int(span.sum())
        self.symbol_at[:used] = np.repeat(order, span)
        self.length_at[:used] = np.repeat(lengths[order], span)

    def encode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, first byte of each document and the end, bit of each symbol within its document)."""
        bits = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(bits)
        at = np.concatenate([[0], ends])
        size = np.diff(at[bounds])
        whole = (size + 7) // 8
        byte = np.concatenate([[0], np.cumsum(whole)])
        inside = at[:-1] - np.repeat(at[bounds[:-1]], np.diff(bounds))
        place = np.repeat(byte[:-1] * 8, np.diff(bounds)) + inside
        # Each code touches two 32-bit words at most; sums of disjoint bits are exact in doubles.
        word, shift = place >> 5, (place & 31).astype(np.uint64)
        wide = self.codes[ids] << (np.uint64(64) - shift - bits.astype(np.uint64))
        n = int(byte[-1] // 4) + 2
        out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        return out.astype(">u4").view(np.uint8)[: byte[-1]], byte, inside

    def decode(self, data: np.ndarray, start_bit: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Symbols of stretches that begin at the given bits, end to end."""
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        order = np.argsort(-count, kind="stable")
        place, left, to = start_bit[order].astype(np.int64), count[order], (ends - count)[order]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        quads = (padded[:-3].astype(np.uint32) << 24) | (padded[1:-2].astype(np.uint32) << 16) | (padded[2:-1].astype(np.uint32) << 8) | padded[3:]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # stretches with a symbol left
            p = place[:live]
            window = (quads[p >> 3] >> (32 - self.width - (p & 7)).astype(np.uint32)) & np.uint32((1 << self.width) - 1)
            out[to[:live] + step] = self.symbol_at[window]
            place[:live] += self.length_at[window]
        return out


def write_block(doc_ids: np.ndarray | None, n_tokens: np.ndarray, checkpoints: list[bytes], bits: list[bytes]) -> bytes:
    """One block; ``doc_ids`` may be missing altogether. Checkpoints are bit offsets within a document, one for each ``STRIDE`` symbols."""
    body = b"".join(bits)
    flags = NAMELESS if doc_ids is None else 0
    doc_ids = np.zeros(len(n_tokens), np.int64) if doc_ids is None else doc_ids
    parts = [doc_ids.astype("<i8").tobytes(), n_tokens.astype("<u4").tobytes(), np.array([len(b) for b in bits], "<u4").tobytes(), b"".join(checkpoints), body]
    block = HEAD.pack(MAGIC, len(doc_ids), int(n_tokens.sum()), STRIDE, len(body), flags) + b"".join(parts)
    return block + struct.pack("<I", zlib.crc32(block))


def read_block(block: bytes, code: Code) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """(doc_ids or None, n_tokens, ids) of a block, after its checksum."""
    if zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, _, stride, size, flags = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size
    doc_ids = np.frombuffer(block, "<i8", n, at)
    n_tokens = np.frombuffer(block, "<u4", n, at + 8 * n).astype(np.int64)
    sizes = np.frombuffer(block, "<u4", n, at + 12 * n).astype(np.int64)
    stretches = -(-n_tokens // stride)
    total = int(stretches.sum())
    checkpoints = np.frombuffer(block, "<u4", total, at + 16 * n).astype(np.int64)
    data = np.frombuffer(block, np.uint8, size, at + 16 * n + 4 * total)
    of = np.repeat(np.arange(n), stretches)
    nth = np.arange(total) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    begin = (np.cumsum(sizes) - sizes)[of] * 8 + checkpoints
    return None if flags & NAMELESS else doc_ids, n_tokens, code.decode(data, begin, np.minimum(n_tokens[of] - nth * stride, stride))


def _ids_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 16-bit numbers, or 32-bit where one is larger."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in tokens.token_runs(text_array(batch), tokenizer_path):
                ids, bounds = tokens.with_end(ids, bounds, end_id)
                wide = len(ids) and ids.max() >= 1 << 16
                raw = ids.astype("<u4" if wide else "<u2")
                values = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds * raw.itemsize), pa.py_buffer(raw)])
                yield pa.record_batch([batch.column("doc_id").slice(rows.start, len(rows)), pa.array(np.diff(bounds)), values.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _flat_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a batch of the ids table."""
    n_tokens = batch.column("n_tokens").to_numpy()
    size = pc.binary_length(batch.column("ids")).to_numpy()
    parts = [np.frombuffer(v.as_buffer(), "<u2" if s == 2 * n else "<u4") for v, s, n in zip(batch.column("ids"), size, n_tokens, strict=True)]
    return np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32), np.concatenate([[0], np.cumsum(n_tokens)])


def count_ids(ids_table: DataFrame) -> np.ndarray:
    """Global counts, one number for each id up to the largest. Batches count before anything moves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, _ = _flat_ids(batch.slice(at, 1024))
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = ids_table.select("n_tokens", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def _coded(ids_table: DataFrame, lengths: np.ndarray, cuts: list[int]) -> DataFrame:
    """(doc_id, n_tokens, checkpoints, bits, shard) of each document; shards are ranges between the cuts."""
    upper = np.array(cuts, np.int64)  # as many as there are partitions
    shared = ids_table.sparkSession.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, bounds = _flat_ids(batch)
                data, byte, inside = code.encode(ids, bounds)
                marks = inside.astype("<u4")
                checkpoints = [marks[bounds[i] : bounds[i + 1] : STRIDE].tobytes() for i in range(batch.num_rows)]
                bits = [data[byte[i] : byte[i + 1]].tobytes() for i in range(batch.num_rows)]
                doc = batch.column("doc_id")
                shard = np.where(doc.is_null().to_numpy(zero_copy_only=False), len(upper) + 1, np.searchsorted(upper, doc.fill_null(0).to_numpy()))
                columns = [doc, batch.column("n_tokens"), pa.array(checkpoints, pa.binary()), pa.array(bits, pa.binary()), pa.array(shard.astype(np.int32))]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "checkpoints", "bits", "shard"])

    return ids_table.mapInArrow(run, "doc_id long, n_tokens long, checkpoints binary, bits binary, shard int")


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes (blocks, codebook) tables: blocks has shard, block, n_docs, n_tokens and the bytes."""
    spark = docs.sparkSession
    ids_table = materialize(_ids_table(docs, tokenizer_path, end_id), "ids", TEXT_ROWS)
    lengths = code_lengths(count_ids(ids_table))
    codebook = materialize(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary"), "codebook")
    n = 2 * shuffle_partitions(spark)
    cuts = ids_table.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).head()[0] or []
    ordered = _coded(ids_table, lengths, sorted(set(cuts))).repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "bits")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            doc, n_tok, marks, bits = zip(*held, strict=True)
            block = write_block(None if doc[0] is None else np.array(doc, np.int64), np.array(n_tok, np.int64), list(marks), list(bits))
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(doc)], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], ["shard", "block", "n_docs", "n_tokens", "bytes"])

        for batch in batches:
            for doc, n_tok, marks, bits, of in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "checkpoints", "bits", "shard")), strict=True):
                if held and (of != shard or size + n_tok > BLOCK_TOKENS):
                    yield flush()
                    number, held, size = (0 if of != shard else number + 1), [], 0
                shard = of
                held.append((doc, n_tok, marks, bits))
                size += n_tok
        if held:
            yield flush()

    blocks = ordered.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, bytes binary")
    return materialize(blocks, "blocks"), codebook


def read_ids(blocks: DataFrame, codebook: DataFrame, with_ids: bool = True) -> DataFrame:
    """(shard, block, place, doc_id, start_in_block, n_tokens, ids_crc32[, ids]) decoded from the stored bytes."""
    lengths = np.frombuffer(bytes(codebook.head()["lengths"]), np.uint8)  # a byte for each id of the vocabulary
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)
    names = ["shard", "block", "place", "doc_id", "start_in_block", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(shared.value)
        for batch in batches:
            for shard, number, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc, n_tok, ids = read_block(value.as_buffer().to_pybytes(), code)
                bounds = np.concatenate([[0], np.cumsum(n_tok)])
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[bounds[i] : bounds[i + 1]]) for i in range(len(n_tok))]
                more = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                n = len(n_tok)
                doc = pa.nulls(n, pa.int64()) if doc is None else pa.array(doc)
                yield pa.record_batch([pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(np.arange(n)), doc, pa.array(bounds[:-1]), pa.array(n_tok), pa.array(crc, pa.int64()), *more], names)

    schema = "shard int, block int, place long, doc_id long, start_in_block long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("shard", "block", "bytes").mapInArrow(run, schema)


def id_report(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files after they are written."""
    blocks, codebook = write_ids(docs, tokenizer_path, end_id)
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each shard, whose number doesn't follow the data
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("block_start"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("from"))
    rows = read_ids(blocks, codebook, with_ids=False)
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("from") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32")
