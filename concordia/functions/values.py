"""Typed values in cells: dates, percents, quantities and amounts in one canonical text each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordia.functions.normalize import nfkc, normalize

# The forms that count as an amount, a percent, a quantity and a date.
AMOUNT = r"^(?:人民币|¥|￥)?([+-]?\d[\d,]*(?:\.\d+)?)(万)?元?$"
PERCENT = r"^([+-]?\d+(?:\.\d+)?)(%|％|百分之)$"
QUANTITY = r"^([+-]?\d+(?:\.\d+)?)(套|台|个|项|批|份|件|人天|天|月|年)$"
DATE_FORMS = (r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")


def compact(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), r"(?U)\s+", "")


def canonical_date(text: Column) -> Column:
    """YYYY-MM-DD of the first date in the text, unchecked by the calendar; empty if none."""
    flat, found = compact(text), F.lit("")
    for form in reversed(DATE_FORMS):
        part = lambda i, form=form: F.lpad(F.regexp_extract(flat, form, i), 4 if i == 1 else 2, "0")
        found = F.when(flat.rlike(form), F.concat_ws("-", part(1), part(2), part(3))).otherwise(found)
    return found


def canonical_amount(text: Column) -> Column:
    """Two decimals; ten thousands are multiplied out; empty for anything else, dates included."""
    flat = compact(text)
    value = F.regexp_replace(F.regexp_extract(flat, AMOUNT, 1), ",", "").cast("decimal(30,6)")
    value = value * F.when(F.regexp_extract(flat, AMOUNT, 2) != "", 10000).otherwise(1)
    good = flat.rlike(AMOUNT) & ~flat.rlike("[年月日]")
    return F.when(good, F.bround(value, 2).cast("decimal(30,2)").cast("string")).otherwise("")


def canonical_percent(text: Column) -> Column:
    flat = compact(text)
    return F.when(flat.rlike(PERCENT), F.regexp_extract(flat, PERCENT, 1).cast("decimal(30,4)").cast("string")).otherwise("")


def canonical_quantity(text: Column) -> Column:
    flat = compact(text)
    return F.when(flat.rlike(QUANTITY), F.concat(F.regexp_extract(flat, QUANTITY, 1).cast("decimal(30,4)").cast("string"), F.regexp_extract(flat, QUANTITY, 2))).otherwise("")


def typed_cell(text: Column) -> Column:
    """The first type that fits, as prefix:value; else the normalised text."""
    found = normalize(text)
    for prefix, of in (("amount", canonical_amount), ("quantity", canonical_quantity), ("percent", canonical_percent), ("date", canonical_date)):
        value = of(text)
        found = F.when(value != "", F.concat(F.lit(f"{prefix}:"), value)).otherwise(found)
    return found


def business_tokens(text: Column) -> Column:
    """Distinct typed tokens of a text: amounts, dates, percents, numbers with units."""
    flat = nfkc(text)
    take = lambda pattern, kind: F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(f"{kind}:"), F.regexp_replace(x, r"[,\s]", "")))
    parts = [
        take(r"((?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2})", "date"),
        take(r"(\d+(?:\.\d+)?)\s*[%％]", "percent"),
        take(r"(?:[¥￥$]|人民币)\s*(\d[\d,]*(?:\.\d+)?)", "amount"),
        take(r"(\d+(?:\.\d+)?\s*(?:days?|months?|years?|天|个月|年|日))", "term"),
    ]
    return F.array_distinct(F.concat(*parts))


def token_overlap(a: Column, b: Column) -> Column:
    """100 if neither side has tokens, 70 if one has none, else their Jaccard share of 100."""
    both = F.size(F.array_intersect(a, b)) * 100.0 / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100.0).when((F.size(a) == 0) | (F.size(b) == 0), 70.0).otherwise(both)


def date_precision(text: Column) -> Column:
    """day or month, as far as a date says; null where the text is no date of a four-digit year."""
    flat = F.regexp_replace(text, r"(?U)\s+", "")
    part = lambda i: F.regexp_extract(flat, r"^(\d{4})年(\d{1,2})月(?:(\d{1,2})日?)?$", i)
    has_day = part(3) != ""
    real = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.when(has_day, F.lpad(part(3), 2, "0")).otherwise("01")), "yyyy-MM-dd")
    return F.when((part(1) != "") & (part(1) != "0000") & real.isNotNull(), F.when(has_day, "day").otherwise("month"))
