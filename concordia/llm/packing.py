"""Best-fit packing by length patterns: non-negative least squares, then best fit for the rest.

Only the histogram of lengths (at most ``capacity`` numbers) reaches the driver. There, patterns of
one to three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted
to the histogram by non-negative least squares and rounded, and what is left is packed best-fit
by decreasing length, whole groups of equal bins at a time. The plan is as large for ten documents
as for ten billion; executors give each piece its place by its rank among pieces of its length.

* null and empty texts: the end id alone, a piece of length 1
* texts longer than a sequence: cut into whole sequences and a last shorter piece
* repeated rows, ties: each row is packed by itself; which of two equal pieces goes where is open
* rows whose doc_id is null are packed like any other; empty table: no rows
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm import tokens
from concordia.llm.storage import TEXT_ROWS, lean, materialize, shuffle_partitions
from concordia.llm.text_kernel import text_array

CAPACITY = 4096
END_ID = 1
#: Partners of a length that enter three-length patterns, the most frequent ones.
PARTNERS = 48
ROUNDS = 400
#: Shares of the fitted repeats that are tried; rounding leaves the tail more to choose from with fewer.
SHARES = (1.0, 0.95, 0.85, 0.7, 0.4)

Plan = list[tuple[tuple[int, ...], int]]


def patterns_of(histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none), longest first, that fill a sequence exactly."""
    have = histogram > 0
    found = []
    lengths = np.flatnonzero(have)
    lengths = lengths[lengths > 0]
    pair = lengths[(lengths < capacity) & have[capacity - np.minimum(lengths, capacity)] & (2 * lengths >= capacity)]
    found.append(np.stack([pair, capacity - pair, np.zeros_like(pair)], axis=1))
    for a in lengths[(3 * lengths >= capacity) & (lengths < capacity - 1)]:
        b = lengths[(lengths <= a) & (2 * lengths >= capacity - a) & (lengths < capacity - a)]
        b = b[have[capacity - a - b]]
        c = capacity - a - b
        best = np.argsort(-np.minimum(histogram[b], histogram[c]), kind="stable")[:PARTNERS]
        found.append(np.stack([np.full(len(best), a), b[best], c[best]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative repeats x that minimise the squared misfit of the histogram, by accelerated
    projected gradients. Misfits weigh by 1 / count, so rare lengths are not drowned by common ones."""
    n = len(histogram)
    weight = 1 / np.maximum(histogram, 1)
    weight[0] = 0
    uses = np.bincount(patterns.reshape(-1), minlength=n)
    step = 1 / max(1e-12, float((uses * weight)[1:].max()) * 3)
    x = np.zeros(len(patterns))
    y, t = x.copy(), 1.0
    target = histogram.astype(float)
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, j], y, n) for j in range(3))
        misfit = (made - target) * weight
        slope = misfit[patterns].sum(axis=1)
        fresh = np.maximum(0, y - step * slope)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = fresh + (t - 1) / t_next * (fresh - x)
        x, t = fresh, t_next
    return x


def round_down(patterns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> Plan:
    """Whole repeats, the largest first, none beyond what the histogram still has. Changes ``left``."""
    plan: Plan = []
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 0.5:
            break
        lengths = tuple(int(v) for v in patterns[i] if v)
        r = min(int(repeats[i] + 0.5), *(int(left[v]) // lengths.count(v) for v in lengths))
        if r:
            plan.append((lengths, r))
            for v in lengths:
                left[v] -= r
    return plan


def best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit by decreasing length over counts: equal bins are handled together."""
    bins: dict[int, list[tuple[tuple, int]]] = {}  # free space -> (chain of lengths, number of bins)
    mask = 0  # bit f: some bin has f free

    def put(free: int, chain: tuple, n: int) -> None:
        nonlocal mask
        bins.setdefault(free, []).append((chain, n))
        mask |= 1 << free

    for length in range(len(left) - 1, 0, -1):
        count = int(left[length])
        while count:
            fits = mask >> length
            if not fits:
                each = min(capacity // length, count)
                n = count // each
                chain: tuple = ()
                for _ in range(each):
                    chain = (chain, length)
                put(capacity - each * length, chain, n)
                count -= n * each
                continue
            free = length + (fits & -fits).bit_length() - 1
            chain, n = bins[free].pop()
            if not bins[free]:
                mask &= ~(1 << free)
            used = min(n, count)
            if n > used:
                put(free, chain, n - used)
            put(free - length, (chain, length), used)
            count -= used
    plan: Plan = []
    for groups in bins.values():
        for chain, n in groups:
            lengths = []
            while chain:
                chain, v = chain
                lengths.append(v)
            plan.append((tuple(reversed(lengths)), n))
    return plan


def plan_of(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """(lengths, number of sequences) groups that hold every piece of the histogram once."""
    rest = histogram.astype(np.int64).copy()
    plan: Plan = [((capacity,), int(rest[capacity]))] if rest[capacity] else []
    rest[capacity] = 0
    patterns = patterns_of(rest, capacity)
    if not len(patterns):
        return plan + best_fit(rest, capacity)
    repeats, tried = fit_repeats(patterns, rest), []
    for share in SHARES:
        left = rest.copy()
        tried.append(round_down(patterns, share * repeats, left) + best_fit(left, capacity))
    return plan + min(tried, key=lambda p: sum(n for _, n in p))


class Slots:
    """Where the k-th piece of a length goes, from a plan."""

    def __init__(self, plan: Plan) -> None:
        rows, seen, sequence = [], {}, 0
        for lengths, n in plan:
            offset = 0
            for v in lengths:
                k = seen.get(v, 0)
                seen[v] = k + n
                rows.append((v << 44 | k, sequence - k, offset))
                offset += v
            sequence += n
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.key, self.shift, self.offset = table.T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank from 0."""
        at = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        return rank + self.shift[at], self.offset[at]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], *keep): whole texts as ids, cut where longer."""
    docs = docs.select("doc_id", "text", *keep)
    schema = docs.drop("text").selectExpr("doc_id", "0 as piece", "0L as start", "0L as length", "0L as ids_crc32", *(["array(0) as ids"] if with_ids else []), *keep).schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, bounds in tokens.token_runs(text_array(batch), tokenizer_path):
                ids, bounds = tokens.with_end(ids, bounds, end_id)
                length = np.diff(bounds)
                pieces = -(-length // capacity)
                row = np.repeat(np.arange(len(length)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                n = np.minimum(length[row] - start, capacity)
                begin = bounds[row] + start
                crc = [zlib.crc32(ids[b : b + m]) for b, m in zip(begin.tolist(), n.tolist(), strict=True)]
                source = batch.take(pa.array(row + rows.start))
                more = [pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
                columns = [source.column("doc_id"), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), *more, *(source.column(c) for c in keep)]
                yield pa.record_batch(columns, schema.names)

    return docs.mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to ``capacity``.

    A piece's rank among its length's pieces is its rank in a bucket (a hash of the piece) plus the
    counts of the buckets before, so a length that a third of all pieces share is numbered by
    many tasks.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces", TEXT_ROWS).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(max(64, 4 * shuffle_partitions(spark)))))
    cells = materialize(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    slots = spark.sparkContext.broadcast(Slots(plan_of(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = pieces.withColumn("_rank", F.row_number().over(inside) - 1).join(cells, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_l", "_b", "_before")
    schema = ranked.drop("_rank").selectExpr("*", "0L as sequence_id", "0L as offset").schema

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.value.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            rest = batch.select([n for n in batch.schema.names if n != "_rank"])
            yield pa.record_batch([*rest.columns, pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place: sequence_id (from 0, no gaps) and offset (gapless from 0)."""
    return place_pieces(pieces_of(docs, tokenizer_path, capacity, end_id, keep, with_ids), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces placed with their ids."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
