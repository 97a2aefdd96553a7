"""Clause splitting as columns: what opens a clause, how sure that is, its key, and pieces of a block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.normalize import nfkc, normalize_for_match
from concordia.functions.numbering import NUMERALS, QUANTITY, marker

# Block types that are titles, and types whose text is never a heading.
TITLE_BLOCKS = ("paragraph_title", "doc_title", "title")
TABLE_BLOCKS = ("table", "table_cell", "table_text")
# How far each style of marker raises a heading's score, in the order in which they are tried.
STYLE_SCORES = ((r"^第.+[章节条]$", 0.34), (r"^\d+(?:\.\d+)+$", 0.34), (r"^[一二三四五六七八九十]+$", 0.30), (r"^[（(][一二三四五六七八九十0-9]+[)）]$", 0.20), (r"^\d+$", 0.16))
ACCEPTED, WEAK_AT_MOST = 0.68, 0.55
# Fixed value: a marker inside a block. A list numeral may not go on from another numeral.
INLINE_MARKER = (
    rf"(?:第[{NUMERALS}0-9]+(?:\.\d+)*[章节条]|(?<![第（({NUMERALS}])[{NUMERALS}]+[、.．]|"
    rf"[（(][{NUMERALS}0-9]+[)）]|[①②③④⑤⑥⑦⑧⑨⑩]|\d+(?:\.\d+)*[.、．])"
)
#: Short texts that mean something.
SHORT_BUSINESS = r"^(?:\d{4}年?|\d+(?:\.\d+)?(?:元|万元|台|套|个|项|批|份|天|月|年|%)|[一二三四五六七八九十百千万]+(?:元|万元|台|套|个|项|批|份|天|月|年)?|[甲乙丙丁]方)$"


def heading_score(number: Column, title: Column, block_type: Column, business: Column, date_like: Column, weak: Column) -> Column:
    """struct(score, risks) of a unit that may open a clause; null where it can't.

    ``number`` is the marker, null for an unnumbered title; ``weak`` tells a plain number that may go on from text.
    """
    compact = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", "")
    n, plain, decimal = F.length(compact), number.rlike(r"^\d+$"), number.rlike(r"^\d+(\.\d+)+$")
    titled, no = block_type.isin(*TITLE_BLOCKS), F.lit(0.0)
    strong = titled & plain & n.between(2, 12)
    style = reduce(lambda found, rule: found.when(number.rlike(rule[0]), rule[1]), STYLE_SCORES[1:], F.when(number.rlike(STYLE_SCORES[0][0]), STYLE_SCORES[0][1])).otherwise(no)
    length = F.when(n.between(2, 36), 0.12).when(n.between(37, 100) & decimal, 0.04).when(n == 0, -0.14).when(n > 80, -0.18).otherwise(no)
    signs = [
        style, length, F.when(titled, 0.08).otherwise(no), F.when(business, 0.06).otherwise(no), F.when(plain & business, 0.08).otherwise(no),
        F.when(compact.rlike("[。；;]$"), -0.10).otherwise(no), F.when(date_like, -0.30).otherwise(no),
    ]
    total = reduce(lambda a, b: a + b, signs, F.lit(0.42))
    doubtful = weak & plain & ~strong
    total = F.when(doubtful, F.least(total, F.lit(WEAK_AT_MOST))).otherwise(total)
    risks = F.array_compact(F.array(
        F.when(n == 0, "WEAK_HEADING").when((n > 80) & ~(n.between(37, 100) & decimal), "LONG_HEADING"), F.when(compact.rlike("[。；;]$"), "PUNCTUATED_HEADING"),
        F.when(date_like, "DATE_LIKE_HEADING"), F.when(doubtful, "WEAK_NUMERIC_MARKER"),
    ))
    numbered = F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"), risks.alias("risks"))
    bare = F.struct(F.when(business, 0.82).otherwise(0.74).alias("score"), F.array().cast("array<string>").alias("risks"))
    return F.when(number.isNull(), F.when(titled & (n > 0), bare)).otherwise(F.when(~block_type.isin(*TABLE_BLOCKS), numbered))


def starts_clause(score: Column, first: Column, section_changes: Column) -> Column:
    """A unit that opens a clause: a sure heading, the document's first unit, or the first of another section type."""
    return (F.coalesce(score, F.lit(0.0)) >= ACCEPTED) | first | section_changes


def path_label(label: Column) -> Column:
    """A heading's label by its number: n, the number with _ for points, a blank and the title; else the label itself."""
    found = marker(label)
    after = F.regexp_replace(F.substring(F.trim(nfkc(label)), F.length(found["raw"]) + 1, F.lit(1 << 20)), r"^[、.．\s　]+", "")
    name = F.concat(F.lit("n"), F.regexp_replace(found["number"], r"\.", "_"))
    return F.when(found.isNull(), label).when(after == "", name).otherwise(F.concat(name, F.lit(" "), after))


def clause_key(section_type: Column, path: Column, number: Column, text: Column) -> Column:
    """Section type and folded labels of the path, joined by /; without a path the number, without that 32 characters of the first line."""
    labels = F.filter(F.transform(F.filter(path, lambda x: x != ""), lambda x: normalize_for_match(path_label(x))), lambda x: x != "")
    own = F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("n"), F.regexp_replace(number, r"\.", "_"))).otherwise(F.substring(F.element_at(F.split(text, "\n"), 1), 1, 1 << 10))
    last = F.when(F.coalesce(number, F.lit("")) != "", normalize_for_match(own)).otherwise(F.substring(normalize_for_match(own), 1, 32))
    kind = F.when(F.coalesce(section_type, F.lit("")) == "", "main_contract").otherwise(section_type)
    return F.concat_ws("/", kind, F.when(F.size(labels) > 0, F.array_join(labels, "/")).otherwise(last))


def inline_pieces(text: Column) -> Column:
    """Pieces of a block, cut before each marker that follows a character beyond ASCII and is no amount, date or quantity."""
    amount = QUANTITY.removeprefix("(?i)^")
    cut = rf"(?i)(?<=[^\x00-\x7F])(?<![\d０-９])(?<![.．](?=\d))(?!\d\d)(?={INLINE_MARKER})(?!{amount})"
    pieces = F.transform(F.split(F.regexp_replace(text, cut, "\x01"), "\x01"), lambda x: F.trim(x))
    return F.filter(pieces, lambda x: x != "")


def is_short_noise(text: Column, box: Column, block_type: Column, confidence: Column, width: Column, height: Column, sure: float = 0.7) -> Column:
    """A short fragment that is no text: unsure letters, numbers or signs in a tiny or edge block. ``box`` has x0, y0, x1, y1.

    Short business text (amounts, years, parties) stays.
    """
    compact = F.regexp_replace(text, r"(?U)\s+", "")
    unsure, line = F.coalesce(confidence < sure, F.lit(False)), F.lower(F.coalesce(block_type, F.lit(""))) == "ocr_line"
    low, tall = box["y1"] - box["y0"] <= F.greatest(height * 0.02, F.lit(16.0)), box["x1"] - box["x0"] <= F.greatest(width * 0.035, F.lit(16.0))
    ends = line & (height > 0) & ((box["y1"] <= height * 0.08) | (box["y0"] >= height * 0.92))
    edge = ends | (line & (width > 0) & ((box["x0"] <= width * 0.03) | (box["x1"] >= width * 0.97)))
    letters, number, signs = compact.rlike("^[A-Za-z]{1,5}$") & unsure, compact.rlike(r"^[(（]?[-—_~]*\d{1,2}[)）.]?$") & unsure, compact.rlike(r"(?U)^[\W_]{1,5}$") & unsure
    short_end = compact.rlike(r"^[A-Za-z0-9#]{1,3}$") | compact.rlike(r"^[\x{4e00}-\x{9fff}]$") | compact.rlike(r"(?U)^[\W_]{1,3}$")
    noise = (line & letters & low) | (ends & short_end) | (((low & tall) | edge) & (letters | number | signs))
    return (F.length(compact) <= 5) & ~compact.rlike(SHORT_BUSINESS) & noise
