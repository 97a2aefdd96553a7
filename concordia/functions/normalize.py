"""Text folding as columns. NFKC comes from ICU, which every Spark JVM loads, so nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that matching drops, and that differences drop (comma and period stay there).
MATCH_PUNCTUATION = """，。；：、”“‘’（）()[]【】《》,.!?:;"'"""
DIFF_PUNCTUATION = """，。；：、”“‘’（）()[]【】《》!?:;"'"""
# A line that only numbers a page, and one that only gives the contract's number. White space within a line.
_GAP = r"[^\S\n]*"
PAGE_NUMBER = rf"(?:(?:第{_GAP})?\d+{_GAP}(?:页)?|共{_GAP}\d+{_GAP}页{_GAP}第{_GAP}\d+{_GAP}页)"
CONTRACT_NUMBER = rf"(?:合同编号|编号)[:：]{_GAP}\S+"
#: Fixed value: brackets around the year of a document number, of one kind on both sides.
YEAR_BRACKETS = r"(?U)(?:\(\s*(\d{4})\s*\)|（\s*(\d{4})\s*）|〔\s*(\d{4})\s*〕)(?=\s*\d{1,4}\s*号)"
_LINE_BREAK = r"\r\n|[\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"
#: How the line patterns are read: ^ and $ at line feeds alone, classes by Unicode.
_BY_LINE = "(?dmU)"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nfkc(text: Column) -> Column:
    """Compatibility composition; it also opens ligatures. Null counts as empty."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))


def clean_line(line: Column) -> Column:
    """White space runs as one blank, no edges; a contract-number line becomes empty."""
    flat = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    return F.regexp_replace(flat, f"(?U)^{CONTRACT_NUMBER}$", "")


def is_page_number(line: Column) -> Column:
    return line.rlike(rf"(?U)^\s*{PAGE_NUMBER}\s*$")


def normalize(text: Column) -> Column:
    """Folded text: clean lines without page and contract numbers; null counts as empty. Whole texts, not lines, go
    through each pattern."""
    lines = F.regexp_replace(nfkc(text), _LINE_BREAK, "\n")
    lines = F.regexp_replace(lines, r"[ \t\x{1680}]+", " ")  # composition has left no other blanks
    lines = F.regexp_replace(F.regexp_replace(F.trim(lines), " \n", "\n"), "\n ", "\n")
    lines = _bound(lines, lambda x: F.when(x.contains("编号"), F.regexp_replace(x, f"{_BY_LINE}^{CONTRACT_NUMBER}$", "")).otherwise(x))
    lines = F.regexp_replace(lines, f"{_BY_LINE}^{PAGE_NUMBER}$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"\n{2,}", "\n"), r"^\n|\n$", ""))


def fold_year_brackets(text: Column) -> Column:
    """One bracket form around the year of a document number; one zero in a Chinese year."""

    def years(x: Column) -> Column:
        # Four characters before the year sign: each zero is folded where it stands.
        for i in range(4):
            x = F.regexp_replace(x, f"[0零](?<=[一二三四五六七八九〇零0]{{{i}}}[0零])(?=[一二三四五六七八九〇零0]{{{3 - i}}}年)", "〇")
        return x

    text = _bound(text, lambda x: F.when(x.contains("年"), years(x)).otherwise(x))
    return _bound(text, lambda x: F.when(x.contains("号"), F.regexp_replace(x, YEAR_BRACKETS, "($1$2$3)")).otherwise(x))


def _flat(text: Column) -> Column:
    return F.translate(fold_year_brackets(normalize(text)), " \n", "")


def normalize_for_match(text: Column) -> Column:
    return F.lower(F.translate(_flat(text), MATCH_PUNCTUATION, ""))


def normalize_for_diff(text: Column) -> Column:
    flat = F.regexp_replace(_flat(text), r"(?U),(?<=\d,)(?=\d{3}(?:\D|$))", "")
    return F.lower(F.translate(flat, DIFF_PUNCTUATION, ""))


def punctuation_fold(text: Column) -> Column:
    """Letters, marks and digits alone."""
    return F.regexp_replace(text, r"(?U)[\W_]+", "")


def shorten(text: Column, limit: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def text_key(text: Column) -> Column:
    """The folded text that makes two cells or lines count as equal."""
    return normalize_for_match(text)
