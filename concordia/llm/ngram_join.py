"""N-gram Jaccard join by vertical partitioning, and the components of its links.

All n-grams stand in one global order, that of their 64-bit hashes. The order is cut into
fragments. Three times over fragments are dealt out, counted apart and summed:

1. A set x that is linked with any other shares all but (1 - t)|x| of its n-grams with it. So in
   each shard of the order the n-grams that stand in one set alone are told from the others, and
   sums per set rule out each set with too many of its own. A first stretch of the order
   (``STRETCH`` times 1 - t of it) is enough for most sets; what it leaves is counted over the
   whole order.
2. Two sets whose Jaccard similarity reaches p/q differ in at most D = (|x| + |y|)(q - p)/(q + p)
   n-grams, so of D + 1 fragments one at least holds the same n-grams in both: sets that agree in
   a whole fragment are the candidates, and no link is lost.
3. The overlap of a candidate pair is counted fragment by fragment, in separate rows, and summed
   per pair.

Identical sets are one class from the start. Groups that share a fragment are never expanded into
all their pairs: each member meets the group's first member; once those links have merged
components, only pairs across components that a parity bitmap cannot rule out are counted. Groups
are compared in tiles of about ``TILE`` members, so a group's size bounds no task's memory; a group
of near copies that are mutually just under the threshold still costs the square of its size, spread
over its tiles.

* null and empty texts, texts without a word: an empty set, linked with nothing
* fewer than n words: the whole sequence is the one n-gram
* repeated rows: each row gets its row of the result; where rows of one doc_id differ in text, the
  set with the smallest digest stands for the doc_id in links
* rows whose doc_id is null: n_shingles is given, component_id is null
* empty table: no rows; other columns of the input play no part; very long texts: whole
"""


from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm.components import connected_components
from concordia.llm.passages import packed_texts, unpacked
from concordia.llm.storage import TEXT_ROWS, discard, lean, materialize, shuffle_partitions
from concordia.llm.text_kernel import Words, inside_mask, joined_hashes, mix, text_array, window_ranges, word_runs

SHINGLE, THRESHOLD = 5, Fraction(8, 10)
#: Fragments in which overlaps are counted; a row of the join holds one fragment of a set.
COUNT_FRAGMENTS = 4
BITMAP_WORDS = 8
#: Bits a member of the longer bitmap by which a pair is judged before it is counted, a power of two.
MARK_BITS = 2
#: The first stretch of the order, as a multiple of the share of n-grams that a linked set may have alone.
STRETCH = Fraction(3, 2)
#: Bytes of an n-gram's hash in the count of lone ones. A collision makes two n-grams look shared, which rules out less.
LONE_BYTES = 6
#: N-grams of a shard in that count, at most about; shards follow the data.
SHARD_GRAMS = 2_000_000
#: Members of a group that are compared with one another in one go.
TILE = 1024
_U = np.uint64


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run: (hashes, text of each hash)."""
    h = words.hashes()
    n = np.diff(words.first)
    of = np.repeat(np.arange(len(n)), n)
    parts, owners = [], []
    for c in range(1, k + 1):
        hashes = joined_hashes(h, c) + _U(c)
        if c == k:
            lo, hi = window_ranges(words.first, k)
            at = np.flatnonzero(inside_mask(len(hashes), lo, np.minimum(hi, len(hashes))))
        else:
            at = words.first[:-1][n == c]
        parts.append(mix(hashes[at]))
        owners.append(of[at])
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], owner[new]


def _set_digests(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit digests of each set, whatever the order of its members."""
    size = np.bincount(owner, minlength=n)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    starts = np.cumsum(size) - size
    some = size > 0
    if len(value):
        one[some] = np.add.reduceat(mix(value + _U(1)), starts[some])
        two[some] = np.add.reduceat(mix(value ^ _U(0xA5A5A5A5A5A5A5A5)), starts[some])
    return size, one, two


class Schemes:
    """Intervals of set sizes and the number of fragments for each.

    Sizes of a linked pair lie in one interval or two neighbouring ones, so each set is cut by its
    own interval's scheme and by the next one's.
    """

    def __init__(self, threshold: Fraction, longest: int) -> None:
        p, q = threshold.numerator, threshold.denominator
        tops = [1]
        while tops[-1] < longest:
            tops.append(max(tops[-1] + 1, -(-tops[-1] * q // p)))
        tops.append(max(tops[-1] + 1, -(-tops[-1] * q // p)))
        self.tops = np.array(tops)
        #: n-grams by which a linked pair of the scheme may differ
        self.differ = 2 * self.tops * (q - p) // (q + p)
        # Small sets get more fragments than needed, so that few of them are empty.
        self.cuts = np.where(self.differ <= 3, np.minimum(4 * (self.differ + 1), np.maximum(self.tops, 1)), self.differ + 1)
        self.cuts = np.maximum(self.cuts, self.differ + 1)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, size)


def signatures(value: np.ndarray, owner: np.ndarray, size: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of each fragment of each set, under its two schemes."""
    sigs, owners = [], []
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    member = mix(value + _U(7))
    for step in (0, 1):
        scheme = schemes.of(size) + step
        cuts = schemes.cuts[scheme]
        fragment = ((value >> _U(32)) * cuts[owner].astype(np.uint64)) >> _U(32)
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
        at = np.flatnonzero(new)
        key = scheme[owner[at]].astype(np.uint64) * _U(0x9FB21C651E98DF25) + fragment[at]
        sigs.append(mix(np.add.reduceat(member, at) + mix(key)))
        owners.append(owner[at])
        # If no more fragments hold anything than may differ, an equal one may be empty in both.
        filled = np.bincount(owner[at], minlength=len(size))
        for i in np.flatnonzero((size > 0) & (filled <= schemes.differ[scheme])):
            lo, hi = np.searchsorted(owner[at], [i, i + 1])
            empty = np.setdiff1d(np.arange(cuts[i], dtype=np.uint64), fragment[at[lo:hi]])
            sigs.append(mix(_U(0x1B873593) + mix(scheme[i : i + 1].astype(np.uint64) * _U(0x9FB21C651E98DF25) + empty)))
            owners.append(np.full(len(empty), i))
    return np.concatenate(sigs), np.concatenate(owners)


def _low_bytes(value: np.ndarray) -> np.ndarray:
    return value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LONE_BYTES]


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A column of byte strings that lie end to end in ``data``."""
    values = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return values.cast(pa.binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, length of each value)."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8), pc.binary_length(column).to_numpy()


def _sizes(docs: DataFrame, k: int, lower: bool, stretch: Fraction) -> DataFrame:
    """(doc_id, n_shingles, held, d1, d2, part) of each row; ``part`` has short hashes of its ``held`` n-grams in the order's first stretch."""
    cut = _U(min(1 << 32, (1 << 32) * stretch.numerator // stretch.denominator))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch)
            for words in word_runs(texts, lower):
                n = len(words.rows)
                value, owner = shingle_sets(words, k)
                size, one, two = _set_digests(value, owner, n)
                early = (value >> _U(32)) < cut
                edges = np.searchsorted(owner[early], np.arange(n + 1))
                ids = batch.column(0).slice(words.rows.start, n)
                columns = [ids, pa.array(size.astype(np.int64)), pa.array(np.diff(edges)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(_low_bytes(value[early]), edges * LONE_BYTES)]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "held", "d1", "d2", "part"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, held long, d1 long, d2 long, part binary")


def _shared_grams(sets: DataFrame, total: int, width: int) -> DataFrame:
    """(d1, shared): how many of the n-grams in a set's ``part`` another set's ``part`` has too, or more.

    ``sets`` has d1 (a set's name) and part, hashes of ``width`` bytes, ``total`` in all. Equal sets are one;
    sets without any shared n-gram have no row.
    """
    spark = sets.sparkSession
    shards = max(4 * shuffle_partitions(spark), -(-total // SHARD_GRAMS))

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column("d1").to_numpy()
            _, rows = np.unique(name, return_index=True)
            rows.sort()
            raw, size = _flat(batch.column("part").take(pa.array(rows)))
            size = size // width
            if not len(raw):
                continue
            raw = raw.reshape(-1, width)[:, :LONE_BYTES]
            high = np.zeros((len(raw), 8), np.uint8)
            high[:, :4] = raw[:, LONE_BYTES - 4 :]
            shard = ((high.view("<u8")[:, 0] * _U(shards)) >> _U(32)).astype(np.int64)
            at = np.argsort(shard, kind="stable")
            of, shard = np.repeat(np.arange(len(rows)), size)[at], shard[at]
            new = np.ones(len(at), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(new)  # of each document within each shard
            count = np.diff(np.append(begin, len(at)))
            first = np.flatnonzero(np.append(True, shard[begin][1:] != shard[begin][:-1]))
            docs_at, grams_at = np.append(first, len(begin)), np.append(begin[first], len(at))
            columns = [
                pa.array(shard[begin[first]].astype(np.int32)),
                _binary(name[rows][of[begin]].astype("<i8").view(np.uint8), docs_at * 8),
                _binary(count.astype("<u4").view(np.uint8), docs_at * 4),
                _binary(raw[at], grams_at * LONE_BYTES),
            ]
            yield pa.record_batch(columns, ["shard", "names", "counts", "grams"])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shard = None

        def flush() -> Iterator[pa.RecordBatch]:
            name, gram = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(gram, kind="stable")
            gram, name = gram[order], name[order]
            begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            common = np.minimum.reduceat(name, begin) != np.maximum.reduceat(name, begin)
            common = np.repeat(common, np.diff(np.append(begin, len(gram))))
            gram, name = gram[common], name[common]
            order = np.lexsort((gram, name))
            gram, name = gram[order], name[order]
            once = np.append(True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])) if len(name) else np.zeros(0, bool)
            names, n = np.unique(name[once], return_counts=True)
            if len(names):
                yield pa.record_batch([pa.array(names), pa.array(n)], ["d1", "shared"])

        for batch in batches:
            for of, names, counts, grams in zip(*(batch.column(c) for c in range(4)), strict=True):
                if of.as_py() != shard:
                    if held:
                        yield from flush()
                    shard, held = of.as_py(), []
                raw = np.frombuffer(grams.as_buffer(), np.uint8).reshape(-1, LONE_BYTES)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :LONE_BYTES] = raw
                held.append((np.repeat(np.frombuffer(names.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<u4")), wide.view("<u8")[:, 0]))
        if held:
            yield from flush()

    dealt = sets.select("d1", "part").mapInArrow(deal, "shard int, names binary, counts binary, grams binary")
    dealt = dealt.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(count, "d1 long, shared long").groupBy("d1").agg(F.sum("shared").alias("shared"))


def _possible(counted: DataFrame, sets: DataFrame, threshold: Fraction, width: int = LONE_BYTES) -> DataFrame:
    """Rows of ``counted`` (d1, n_shingles, held, ...) that share enough of their ``held`` n-grams, which
    are in the ``part`` of ``sets`` (d1, held, part), with other sets to be linked at all."""
    p, q = threshold.numerator, threshold.denominator
    total = int(sets.agg(F.sum("held")).head()[0] or 0)
    shared = _shared_grams(sets, total, width)
    alone = F.col("held") - F.coalesce("shared", F.lit(0))
    return counted.join(shared, "d1", "left").where(alone * q <= F.col("n_shingles") * (q - p)).drop("shared")


def _whole_sets(docs: DataFrame, k: int, lower: bool) -> DataFrame:
    """(doc_id, n_shingles, d1, hashes): whole sets, sorted.

    ``docs`` has doc_id, a packed text and the digests d1, d2 of the set that stands for the doc_id; rows
    with another set are passed over. A row that repeats gives its set again.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            texts = pa.array([unpacked(v.as_buffer().to_pybytes()) for v in batch.column("packed")], pa.large_binary()).cast(pa.large_string())
            for words in word_runs(texts, lower):
                value, owner = shingle_sets(words, k)
                size, one, two = _set_digests(value, owner, len(words.rows))
                here = slice(words.rows.start, words.rows.stop)
                own = (one.view(np.int64) == d1[here]) & (two.view(np.int64) == d2[here])
                rows, value = np.flatnonzero(own), value[own[owner]]
                if not len(rows):
                    continue
                edges = np.concatenate([[0], np.cumsum(size[rows])])
                taken = batch.take(pa.array(rows + words.rows.start))
                columns = [taken.column("doc_id"), pa.array(size[rows].astype(np.int64)), taken.column("d1"), _binary(value.astype("<u8").view(np.uint8), edges * 8)]
                yield pa.record_batch(columns, ["doc_id", "n_shingles", "d1", "hashes"])

    schema = "doc_id long, n_shingles long, d1 long, hashes binary"
    return docs.select("doc_id", "packed", "d1", "d2").mapInArrow(run, schema)


def _hash_runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, hashes, size of each set) for parts of a batch of whole sets."""
    for at in range(0, batch.num_rows, 1024):
        part = batch.slice(at, 1024)
        raw, size = _flat(part.column("hashes"))
        yield part.column("doc_id").to_numpy(), raw.view("<u8"), size // 8


def _signature_rows(sets: DataFrame, threshold: Fraction, longest: int) -> DataFrame:
    """(sig, doc_id): a row for each fragment of each set."""
    schemes = Schemes(threshold, longest)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, size in _hash_runs(batch):
                sig, of = signatures(value, np.repeat(np.arange(len(size)), size), size, schemes)
                for at in range(0, len(sig), 1 << 18):
                    yield pa.record_batch([pa.array(sig[at : at + (1 << 18)].view(np.int64)), pa.array(doc[of[at : at + (1 << 18)]])], ["sig", "doc_id"])

    return sets.select("doc_id", "hashes").mapInArrow(run, "sig long, doc_id long")


def _groups(signatures: DataFrame) -> DataFrame:
    """(sig, doc_id, centre, members): rows whose sig another doc_id has; the centre is the smallest of them.

    Groups are counted with map-side sums; the join that follows is one that adaptive execution
    splits where a sig is hot.
    """
    groups = signatures.groupBy("sig").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_top"), F.count("*").alias("members"))
    return signatures.join(groups.where("centre <> _top").drop("_top"), "sig")


def _fragment_rows(sets: DataFrame) -> DataFrame:
    """(doc_id, n, fragment, hashes): sets cut for counting."""
    names = ["doc_id", "n", "fragment", "hashes"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    bounds = [_U(f * ((1 << 64) // COUNT_FRAGMENTS)) for f in range(1, COUNT_FRAGMENTS)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, size in _hash_runs(batch):
                rows, edges = [], np.concatenate([[0], np.cumsum(size)])
                for i, doc_id in enumerate(doc.tolist()):
                    v = value[edges[i] : edges[i + 1]]
                    cut = [0, *np.searchsorted(v, bounds).tolist(), len(v)]
                    rows += [(doc_id, len(v), f, v[cut[f] : cut[f + 1]].tobytes()) for f in range(COUNT_FRAGMENTS)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return sets.select("doc_id", "hashes").mapInArrow(run, "doc_id long, n long, fragment int, hashes binary")


def _marks(sets: DataFrame) -> DataFrame:
    """(doc_id, n, bitmap, mark): parity bitmaps of each set, one of a fixed length and one that follows its size."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value, size in _hash_runs(batch):
                edges = np.concatenate([[0], np.cumsum(size)])
                parts = [value[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                short = [parity_bitmap(v, 64 * BITMAP_WORDS).tobytes() for v in parts]
                long = [parity_bitmap(v, mark_bits(len(v))).tobytes() for v in parts]
                yield pa.record_batch([pa.array(doc), pa.array(size.astype(np.int64)), pa.array(short, pa.binary()), pa.array(long, pa.binary())], ["doc_id", "n", "bitmap", "mark"])

    return sets.select("doc_id", "hashes").mapInArrow(run, "doc_id long, n long, bitmap binary, mark binary")


def mark_bits(n: int) -> int:
    return max(64 * BITMAP_WORDS, 1 << (MARK_BITS * n - 1).bit_length())


def parity_bitmap(hashes: np.ndarray, length: int) -> np.ndarray:
    """Bit b tells whether an odd number of members fall on b. Two bitmaps differ in no more bits
    than their sets differ in members."""
    bits = np.bincount((mix(hashes) % _U(length)).astype(np.int64), minlength=length) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little")


def _differing_bits(one: bytes, two: bytes) -> int:
    """Of two bitmaps whose lengths are powers of two; the longer one is folded, which keeps parities."""
    if len(one) < len(two):
        one, two = two, one
    wide = np.bitwise_xor.reduce(np.frombuffer(one, np.uint64).reshape(-1, len(two) // 8), axis=0)
    return int(np.bitwise_count(wide ^ np.frombuffer(two, np.uint64)).sum())


def plausible(pairs: DataFrame, marks: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) pairs that sizes and parity bitmaps do not rule out."""
    p, q = threshold.numerator, threshold.denominator
    one = marks.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("mark").alias("mark_a"))
    two = marks.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("mark").alias("mark_b"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (q - p) // (q + p)
            differ = [_differing_bits(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("mark_a"), batch.column("mark_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(differ, np.int64) <= n))

    near = F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p
    both = pairs.join(one, "a").join(two, "b").where(near).select("a", "b", "n_a", "n_b", "mark_a", "mark_b")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, fragments: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) pairs that reach the threshold: partial overlaps by fragment, then their sum."""
    one = fragments.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("hashes").alias("hashes_a"))
    two = fragments.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("hashes").alias("hashes_b"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True)
            common = [len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in both]
            yield pa.record_batch([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(common, pa.int64())], ["a", "b", "n_a", "n_b", "part"])

    counted = pairs.join(one, "a").join(two, ["b", "fragment"]).mapInArrow(run, "a long, b long, n_a long, n_b long, part long")
    total = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("common"))
    return total.where(f"{threshold.denominator} * common >= {threshold.numerator} * (n_a + n_b - common)").select("a", "b")


def _cross_pairs(groups: DataFrame, threshold: Fraction, nearest: bool) -> DataFrame:
    """Pairs across components within groups, ruled out by bitmaps where these differ too much.

    ``groups`` rows: sig, doc_id, members, component, n, bitmap. With ``nearest``, each member gives its
    one best pair with another component (one for each tile of a large group); else all pairs that are
    left. A group of more than ``TILE`` members is dealt into tiles: each pair of its parts is a group.
    """
    p, q = threshold.numerator, threshold.denominator

    def pairs_of(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
        middle = int(np.searchsorted(own, own[0], "right"))  # the first part's members, then the second's, or one part
        rows, columns = (len(doc), slice(0, len(doc))) if middle == len(doc) else (middle, slice(middle, len(doc)))
        other, n_other, comp_other = doc[columns], n[columns], comp[columns]
        for at in range(0, rows, 256):
            to = min(rows, at + 256)
            differ = np.zeros((to - at, len(other)), np.int64)
            for w in range(BITMAP_WORDS):
                differ += np.bitwise_count(bits[at:to, w, None] ^ bits[None, columns, w])
            most = (n[at:to, None] + n_other[None, :]) * (q - p) // (q + p)
            fits = (differ <= most) & (comp[at:to, None] != comp_other[None, :])
            small, large = np.minimum(n[at:to, None], n_other[None, :]), np.maximum(n[at:to, None], n_other[None, :])
            fits &= small * q >= large * p
            if nearest:
                best = np.where(fits, differ, 1 << 30).argmin(axis=1)
                found = np.flatnonzero(fits[np.arange(to - at), best])
                x, y = doc[at + found], other[best[found]]
            else:
                i, j = np.nonzero(fits)
                x, y = doc[at + i], other[j]
            yield np.stack([np.minimum(x, y), np.maximum(x, y)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            doc, comp, n, own = (table.column(c).to_numpy() for c in ("doc_id", "component", "n", "own"))
            bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP_WORDS)
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(edges_of(table)), strict=True):
                if (comp[lo:hi] != comp[lo]).any():
                    for x in pairs_of(doc[lo:hi], comp[lo:hi], n[lo:hi], bits[lo:hi], own[lo:hi]):
                        yield pa.record_batch([pa.array(x[0]), pa.array(x[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            whole = int(edges_of(table)[-2])  # rows before the group that may go on
            yield from flush(table.slice(0, whole)) if whole else ()
            held = [table.slice(whole)]
        if held:
            yield from flush(held[0])

    def edges_of(table: pa.Table) -> np.ndarray:
        key = [table.column(c).to_numpy() for c in ("sig", "lo", "hi")]
        return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0), [True]]))

    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = groups.select("sig", "doc_id", "component", "n", "bitmap", F.pmod(F.xxhash64("doc_id"), tiles).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("_other"))
    rows = rows.select("sig", F.least("own", "_other").alias("lo"), F.greatest("own", "_other").alias("hi"), "own", "doc_id", "component", "n", "bitmap")
    rows = rows.repartition(shuffle_partitions(groups.sparkSession), "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "own", "doc_id")
    return rows.mapInArrow(run, "a long, b long").where("a < b").distinct()


def jaccard_components(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``."""
    sizes = materialize(_sizes(docs, k, lower, STRETCH * (1 - threshold)), "set-sizes", TEXT_ROWS)
    sets = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "held")).alias("set")).select("doc_id", "set.*")
    classes = materialize(sets.groupBy("d1", "d2", "n_shingles", "held").agg(F.min("doc_id").alias("rep")), "set-classes")
    of = materialize(sets.join(classes, ["d1", "d2", "n_shingles", "held"]).select("doc_id", "rep"), "class-of")

    # One set of each class that shares enough with others, by the first stretch and then by all of the order.
    possible = _possible(classes, sizes.where("held > 0"), threshold)
    wanted = materialize(possible.select(F.col("rep").alias("doc_id"), "d1", "d2"), "wanted")
    rows = materialize(sizes.select("doc_id", "n_shingles"), "sizes")
    discard(sizes)
    whole = materialize(_whole_sets(packed_texts(docs.where("doc_id is not null")).join(wanted.hint("merge"), "doc_id"), k, lower), "whole-sets", TEXT_ROWS)
    counted = whole.withColumn("held", F.col("n_shingles"))
    linked = _possible(counted.select("doc_id", "n_shingles", "held", "d1"), counted.select("d1", "held", F.col("hashes").alias("part")), threshold, 8)
    sets = whole.select("doc_id", "n_shingles", "hashes").join(linked.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(sets, "linkable-sets")
    discard(wanted, whole)
    longest = sets.agg(F.max("n_shingles")).head()[0] or 1

    # Groups of sets that agree in a fragment.
    signed = materialize(_signature_rows(sets, threshold, longest), "signatures")
    groups = materialize(_groups(signed), "groups")
    discard(signed)
    marks, fragments = materialize(_marks(sets), "marks"), _fragment_rows(sets)
    stars = groups.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = materialize(plausible(stars, marks, threshold), "pairs")
    links = materialize(verified(tried, fragments, threshold), "links")
    labels = connected_components(links)
    for nearest in (True, False):
        rest = groups.join(labels, groups["doc_id"] == labels["node"], "left").select("sig", "doc_id", "members", F.coalesce("component", "doc_id").alias("component"))
        split = rest.groupBy("sig").agg(F.count("*").alias("_n"), F.min("component").alias("_low"), F.max("component").alias("_high"))
        split = split.where("_n > 2 and _low <> _high").select("sig")
        pairs = _cross_pairs(rest.join(split, "sig").join(marks.drop("mark"), "doc_id"), threshold, nearest)
        pairs = materialize(plausible(pairs.join(tried, ["a", "b"], "left_anti"), marks, threshold), "pairs")
        if pairs.isEmpty():
            continue
        more = materialize(verified(pairs, fragments, threshold), "links")
        tried, links = tried.unionByName(pairs), links.unionByName(more)
        if not more.isEmpty():
            labels = connected_components(links)
    found = of.join(labels, of["rep"] == labels["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    discard(groups, marks, sets)
    rows = rows.join(found, "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; of rows that repeat a doc_id
    with the same text, one. Rows without a word are linked with nothing and stay, as do rows
    whose doc_id is null."""
    found = jaccard_components(docs, k, threshold)
    stay = found.where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
