"""Media columns: signature sniffing that trusts structure, not the declared type.

An Aho-Corasick automaton finds every magic number in one pass over a blob; for each hit a
validator walks the format's own structure and says how long the medium is, or that there is
none. The first medium at offset 0 gives the true type; media elsewhere are carved.

* null and empty blobs: type null, nothing embedded
* magic bytes without the structure, or with a length that runs past the blob: not a medium
* hits inside a confirmed medium belong to it and are not carved again
* repeated rows: each is looked at by itself; empty table: no rows; very large blobs: one pass
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from concordia.llm.storage import lean, materialize

#: Magic numbers and the media type that each may open.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"RIFF": "riff",
    b"%PDF-": "application/pdf",
    b"\x1f\x8b\x08": "application/gzip",
}
#: Samples in a row of a stored payload; payloads fill whole rows.
ROW = 576
FILL = b"\xff"


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    """Chunks with right checksums from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and (name != b"IHDR" or n != 13)):
            return None
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    """Marker segments by their lengths, then entropy-coded data up to the end marker."""
    p, scanned = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF or b[p + 1] in (0x00, 0xFF):
            return None
        marker = b[p + 1]
        if marker == 0xD9:
            return ("image/jpeg", p + 2 - at) if scanned else None
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if marker == 0xDA:
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                elif b[p + 1] == 0xFF:
                    p += 1
                else:
                    break
            if b[p + 1] == 0xD9:
                return "image/jpeg", p + 2 - at
    return None


def _blocks(b: bytes, p: int) -> int:
    """Past a chain of GIF data sub-blocks, or -1."""
    while p < len(b):
        if b[p] == 0:
            return p + 1
        p += b[p] + 1
    return -1


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while 0 <= p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = _blocks(b, p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = _blocks(b, p + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            return None
    return None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    """The outer length must hold whole chunks; the form names the type."""
    if at + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}.get(form)
    end, p = at + 8 + n, at + 12
    if kind is None or end > len(b):
        return None
    while p + 8 <= end:
        p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1 & ~1)
    return (kind, end - at) if p in (end, end + 1) and p > at + 12 else None


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """To the last revision: each ends with startxref and %%EOF, and no other file may begin between them."""
    end, other = -1, b.find(b"%PDF-", at + 5)
    while True:
        start = b.find(b"startxref", max(end, at))
        last = b.find(b"%%EOF", start) if start >= 0 else -1
        if last < 0 or (end >= 0 and 0 <= other < start):
            break
        end = last + 5
    return ("application/pdf", end - at) if end >= 0 and b[at + 5 : at + 6].isdigit() else None


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 1 << 16):
            d.decompress(b[p : p + (1 << 16)])
            if d.eof:
                return "application/gzip", min(len(b), p + (1 << 16)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "riff": _riff, "application/pdf": _pdf, "application/gzip": _gzip,
}


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """Confirmed media of a blob as (offset, length, type), in order, none inside another."""
    found, free = [], 0
    for last, (n, kind) in automaton().iter(blob.decode("latin-1")):
        at = last - n + 1
        if at >= free and (hit := VALIDATORS[kind](blob, at)):
            found.append((at, hit[1], hit[0]))
            free = at + hit[1]
    return found


def media_columns(df: DataFrame, blob: str, declared: str, id_col: str) -> DataFrame:
    """(id, media_type, type_corrected, embedded): the true type, whether it differs from what was
    declared, and the media found elsewhere in the blob with their bytes."""
    part = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())])
    schema = df.selectExpr(f"`{id_col}`", "'' as media_type", "true as type_corrected", "array(named_struct('offset', 0L, 'length', 0L, 'type', '', 'bytes', cast('' as binary))) as embedded").schema
    for f in schema.fields[1:]:
        f.nullable = True

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, wrong, parts = [], [], []
            for b, d in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = b.as_py() or b""
                found = sniff(data)
                whole = found[0][2] if found and found[0][0] == 0 else None
                types.append(whole)
                wrong.append(whole is not None and whole != d)
                parts.append([{"offset": o, "length": n, "type": k, "bytes": data[o : o + n]} for o, n, k in found if o])
            yield pa.record_batch([batch.column(0), pa.array(types, pa.string()), pa.array(wrong), pa.array(parts, pa.list_(part))], [id_col, "media_type", "type_corrected", "embedded"])

    return df.select(id_col, blob, declared).mapInArrow(run, schema)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with 255 to a positive multiple of ``ROW``."""
    return text + FILL * (-len(text) % ROW or (0 if text else ROW))


def encode_png(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey image, a row for each ``ROW`` bytes, no filter."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """Samples of an unfiltered 8-bit grey image, row by row."""
    p, body, width = 8, [], 0
    while p < len(png):
        n, name = struct.unpack_from(">I4s", png, p)
        if name == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", png, p + 8)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
        elif name == b"IDAT":
            body.append(png[p + 8 : p + 8 + n])
        p += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


#: The type that the store gives to all it holds.
DECLARED = "application/octet-stream"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored losslessly as an image."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.large_string())]
                yield pa.record_batch([batch.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([encode_png(payload_of(b)) for b in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored_features(stored: DataFrame) -> DataFrame:
    """Sniffs, carves and decodes stored media; features come from the bytes that were read back.

    feature: true type, size, and mean and entropy of the samples. ``declared`` is what a store says that
    knows no types, ``type_corrected`` whether the media type differs from it, and ``embedded`` has
    the media found inside the payload itself, as offset:length:type, comma-joined.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "type_corrected", "embedded"]

    def row(n: int, blob: bytes) -> tuple:
        at, length, kind = sniff(blob)[0]
        samples = decode_png(blob[at : at + length])
        payload = samples.tobytes()
        share = np.bincount(samples.reshape(-1), minlength=256) / samples.size
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        feature = f"{kind} {samples.shape[1]}x{samples.shape[0]} mean={samples.mean():.4f} entropy={entropy:.4f}"
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), length, hashlib.sha256(blob[at : at + length]).hexdigest(), feature, DECLARED, kind != DECLARED, ",".join(f"{o}:{m}:{k}" for o, m, k in sniff(payload))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [row(n, m.as_buffer().to_pybytes()) for n, m in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
                yield pa.record_batch([batch.column(0), *map(pa.array, zip(*rows, strict=True))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, type_corrected boolean, embedded string")


def media_report(docs: DataFrame) -> DataFrame:
    """Stores each text as a medium in the shared folder, reads the table back, and computes features."""
    return stored_features(materialize(store_texts(docs), "media"))
