"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

Candidates are runs of key-like characters. Inside one, every window of ``WINDOW`` characters of a
class gets its entropy from counts that change by one character in and one out; windows above
the class's threshold join into spans. An allow-list suppresses numbers and dates; of candidates made
of letters, windows whose letters follow one another as in words. Pattern spans are never suppressed.

* null and empty texts: no spans; very long texts: whole, in one pass, with constant extra memory
* repeated rows: each is scanned by itself; empty table: no rows; other columns of the input play no part
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from concordia.llm.storage import lean

#: The kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# What the pattern kinds match, before their length rule.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run can hold no longer one, so the length rule can stand here
WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

WINDOW = 20
#: Bits a character that a window must reach. Random hex comes to about 3.4, random base64 to about 4.1.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_base64": 3.8}
CLASS_RUNS = {"entropy_hex": re.compile(r"[0-9a-f]+|[0-9A-F]+"), "entropy_base64": re.compile(r"[A-Za-z0-9+/_=-]+")}
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")

#: What a whole candidate may be without being a secret.
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9/_=+-]+",  # numbers, dates, card-like groups
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]+Z?",
    )
)
#: What may be words, paths and identifiers, or a named thing with a short number: its windows are judged one by one.
LETTERED = re.compile(r"[A-Za-z/_=-]+|(?:[A-Za-z]+[/_-])*[A-Za-z]+[/_-]?[0-9]{1,6}")
#: For each letter a to z, how well a to z follow it in English, German, French and Spanish words; 5 is
#: as often as any letter would, one more is twice as often.
PAIRS = (
    "55653242503657350667533331",
    "75547322651833641553611251",
    "62436327506632731546531030",
    "64458434711534630555523220",
    "63565433401547443776333522",
    "63446742711633730655512131",
    "63338346612545530665532023",
    "74328225602435620556323022",
    "44655451211658641466040304",
    "83437224535433653353722333",
    "53448444632635442465435131",
    "62358311701632630255421061",
    "75238311602453660254511041",
    "63577474513424631367443021",
    "34553441413558450755634301",
    "72437524601622652756412050",
    "43322122303324234443923211",
    "63448343603444630666433041",
    "52537236613433552368513040",
    "63438317701433540655423143",
    "55547442501667461666221501",
    "73329322711343430333223122",
    "73446328711435630653234301",
    "54756514622453463447232652",
    "55546434502556572467334364",
    "63448333622442532343733447",
)
#: The mean of a window's letter pairs that words reach. Random letters come to about 3.8, identifiers to about 6.
WORDLIKE = 5.0
_PAIR = {a + b: int(v) for a, row in zip("abcdefghijklmnopqrstuvwxyz", PAIRS, strict=True) for b, v in zip("abcdefghijklmnopqrstuvwxyz", row, strict=True)}

_N_LOG_N = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def wordlike(run: str, window: int = WINDOW) -> list[bool]:
    """For each window of ``run``, whether its neighbouring letters follow one another as in words."""
    low = run.lower()
    total, pairs = [0], [0]
    for i in range(len(low) - 1):
        value = _PAIR.get(low[i : i + 2])
        total.append(total[-1] + (value or 0))
        pairs.append(pairs[-1] + (value is not None))
    return [total[i + window - 1] - total[i] >= WORDLIKE * (pairs[i + window - 1] - pairs[i]) for i in range(len(low) - window + 1)]


def entropy_spans(run: str, threshold: float, window: int = WINDOW, harmless: list[bool] | None = None) -> list[tuple[int, int]]:
    """Spans of ``run`` covered by windows whose entropy reaches the threshold, joined where they meet.
    Windows that are ``harmless`` do not count."""
    if len(run) < window:
        return []
    table = _N_LOG_N if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    most = (math.log2(window) - threshold) * window + 1e-9  # the sum of n log n may not pass this
    counts: dict[str, int] = {}
    total, spans, open_at, open_to = 0.0, [], -1, -1
    for i, c in enumerate(run):
        if i >= window:  # before the next one comes in: no count passes ``window``
            out = run[i - window]
            n = counts[out]
            counts[out] = n - 1
            total -= table[n] - table[n - 1]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        if i >= window - 1 and total <= most and not (harmless and harmless[i - window + 1]):
            at = i - window + 1
            if open_at >= 0 and at <= open_to:
                open_to = i + 1
            else:
                if open_at >= 0:
                    spans.append((open_at, open_to))
                open_at, open_to = at, i + 1
    return spans if open_at < 0 else [*spans, (open_at, open_to)]


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), code points, end exclusive; leftmost and non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _outside(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of ``a`` to ``b`` no covered range holds, from left to right."""
    free = []
    for x, y in sorted(covered):
        if x < b and a < y:
            if a < x:
                free.append((a, x))
            a = max(a, y)
    return [*free, (a, b)] if a < b else free


def entropy_findings(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Entropy spans less what is covered already, by a pattern or by a kind tried earlier; hex is tried
    before base64. All that remains of a span is found, in pieces where it is covered in between."""
    found: list[tuple[int, int, str]] = []
    for c in CANDIDATE.finditer(text):
        if any(p.fullmatch(c[0]) for p in ALLOWED):
            continue
        covered = [(a, b) for a, b, _ in taken if a < c.end() and c.start() < b]
        lettered = LETTERED.fullmatch(c[0]) is not None
        for kind, runs in CLASS_RUNS.items():
            for run in runs.finditer(c[0]):
                if len(run[0]) < WINDOW:
                    continue
                for a, b in entropy_spans(run[0], THRESHOLDS[kind], harmless=wordlike(run[0]) if lettered else None):
                    for piece in _outside(a + run.start() + c.start(), b + run.start() + c.start(), covered):
                        found.append((*piece, kind))
                        covered.append(piece)
    return found


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then by kind as listed."""
    if not text:
        return []
    base = pattern_spans(text)
    return sorted(base + entropy_findings(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _mapped(docs: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch)

    return docs.mapInArrow(run, schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans are structs of start, end, kind and the matched text."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("match", pa.string())])

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for text in batch.column("text"):
            t = text.as_py()
            spans.append([{"start": a, "end": b, "kind": k, "match": t[a:b]} for a, b, k in scan(t)])
        return pa.record_batch([batch.column("doc_id"), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return _mapped(docs.select("doc_id", "text"), "doc_id long, spans array<struct<start: bigint, end: bigint, kind: string, match: string>>", rows)


def redact(text: str | None) -> str | None:
    """The text with each secret replaced by <secret>; overlapping spans become one."""
    out, at = [], 0
    for a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return text if not out else "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets redacted from ``text_col``. No row goes."""
    schema = docs.schema

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text_col)
        clean = pa.array([redact(t.as_py()) for t in batch.column(i)], batch.schema.field(i).type)
        return batch.set_column(i, batch.schema.field(i), clean)

    return _mapped(docs, schema, rows)
