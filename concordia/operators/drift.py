"""Clauses that were merged, split or moved: spans of one clause inside another, what is left without them, and
headings that a body match has swallowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.normalize import nfkc, normalize_for_match
from concordia.operators.scoring import type_of

# The shortest clause that is searched for in another, and how many must be found there.
SHORT, LEAST_SHORT, LEAST_FOUND = 20, 8, 2


def search_text(text: Column) -> Column:
    """Folded text without white space."""
    return F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", "")


def _source_index(text: Column) -> Column:
    """Where each character of the search text stands in the text, from 0."""
    pieces = F.transform(F.split(text, ""), search_text)
    return F.flatten(F.transform(pieces, lambda x, i: F.array_repeat(i, F.length(x))))


def contained_spans(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(pair, id, order, inside, start, end): clauses whose folded text stands in one clause of the other side.

    Both sides: pair, id, order, section_type, text. Only clauses of one section type meet, and a needle
    shorter than 20 characters needs 8. Of clauses found at overlapping places the first in order stays.
    """
    side = lambda df, **names: df.select("pair", type_of(F.col("section_type")).alias("_type"), *[F.col(c).alias(n) for c, n in names.items()])
    one = side(needles, id="id", order="order", text="_t").withColumn("_needle", search_text(F.col("_t")))
    two = side(hays, id="inside", text="_text").withColumn("_hay", search_text(F.col("_text")))
    n = F.length("_needle")
    pairs = one.join(two, ["pair", "_type"]).where((n >= LEAST_SHORT) & (F.length("_hay") > n) & F.expr("locate(_needle, _hay) > 0"))
    index, at = _source_index(F.col("_text")), F.expr("locate(_needle, _hay)")
    found = pairs.withColumn("_i", index).select("pair", "inside", "id", "order", F.element_at("_i", at).alias("start"), (F.element_at("_i", at + n - 1) + 1).alias("end"))
    spans = found.groupBy("pair", "inside").agg(F.array_sort(F.collect_list(F.struct("order", "id", "start", "end"))).alias("_s"))  # a clause's worth of rows
    free = lambda acc, s: ~F.exists(acc, lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    kept = F.aggregate("_s", F.slice("_s", 1, 0), lambda acc, s: F.when(free(acc, s), F.array_append(acc, s)).otherwise(acc))
    return spans.select("pair", "inside", F.explode(kept).alias("_k")).select("pair", "_k.id", "_k.order", "inside", "_k.start", "_k.end")


def merged_clauses(needles: DataFrame, hays: DataFrame, mark: str = "M") -> DataFrame:
    """(pair, id, inside, start, end, slice_id): clauses of which two or more were merged into one of the other side.

    Give the sides in the other order, and mark P, for a clause that was split.
    """
    spans = contained_spans(needles, hays)
    many = spans.withColumn("_n", F.count("*").over(Window.partitionBy("pair", "inside"))).where(F.col("_n") >= LEAST_FOUND)
    place = F.row_number().over(Window.partitionBy("pair").orderBy("inside", "start", "order", "id"))
    name = F.concat(F.col("inside").cast("string"), F.lit(mark), F.lpad(place.cast("string"), 2, "0"))
    return many.select("pair", "id", "inside", "start", "end", name.alias("slice_id"))


def sliced(text: Column, start: Column, end: Column) -> Column:
    """The part of a text, without white space at its edges; null where nothing is left."""
    part = F.regexp_replace(F.substring(text, start + 1, end - start), r"(?U)^\s+|\s+$", "")
    return F.when(part != "", part)


def redacted(text: Column, spans: Column) -> Column:
    """A text without the spans (structs of start and end, any order, they may overlap); null where nothing is left."""
    ordered = F.filter(F.array_sort(spans), lambda s: s["start"] < s["end"])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    cut = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("kept"))
    kept = F.aggregate(ordered, first, cut, lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), F.length(text) - acc["at"]))))
    whole = F.regexp_replace(F.when(F.size(spans) > 0, kept).otherwise(text), r"(?U)^\s+|\s+$", "")
    return F.when(whole != "", whole)


def swallowed_headings(clauses: DataFrame) -> DataFrame:
    """(pair, heading_id, compare_id, heading, body): an unmatched numbered heading whose next clause, a body without a
    number, matched a clause that opens with the same title and goes on with exactly that body.

    ``clauses``: pair, order, id, number, title, section_type, text, and of the match, if any: compare_id,
    compare_number, compare_title, compare_type, compare_text.
    """
    window = Window.partitionBy("pair").orderBy("order")
    after = lambda c: F.lead(c).over(window)
    names = ("number", "section_type", "text", "compare_id", "compare_number", "compare_title", "compare_type", "compare_text")
    rows = clauses.select("*", *[after(c).alias(f"_{c}") for c in names])
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    cut = F.locate("\n", F.col("_compare_text"))
    rest = F.substring(F.col("_compare_text"), cut + 1, F.length("_compare_text"))
    kind = type_of(F.col("section_type"))
    rules = (
        F.col("compare_id").isNull() & has("number") & has("title") & F.col("_compare_id").isNotNull() & ~has("_number") & has("_compare_number")
        & (type_of(F.col("_section_type")) == kind) & (type_of(F.col("_compare_type")) == kind) & (cut > 0)
        & (normalize_for_match(F.col("_compare_title")) == normalize_for_match(F.col("title"))) & (search_text(rest) == search_text(F.col("_text")))
    )
    return rows.where(rules).select("pair", F.col("id").alias("heading_id"), F.col("_compare_id").alias("compare_id"), F.substring(F.col("_compare_text"), F.lit(1), cut - 1).alias("heading"), rest.alias("body"))


def promoted_pages(blocks: DataFrame, keys: list[str], least_blocks: int = 2, least_text: int = 80, least_area: float = 0.18, least_covered: float = 0.82) -> DataFrame:
    """(keys, covered): pages that one side has alone: enough blocks, text and area, most of the blocks' weight
    covered by one-sided evidence, and no page aligned with it.

    ``blocks``: keys, chars, x0, y0, x1, y1, width, height (of the page), weight, coverage (0 to 1), aligned.
    """
    area = (F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0")) / (F.max("width") * F.max("height"))
    pages = blocks.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("chars").alias("_c"), area.alias("_a"), F.sum("weight").alias("_w"), F.sum(F.col("weight") * F.col("coverage")).alias("_k"), F.max(F.col("aligned").cast("int")).alias("_m"))
    covered = F.col("_k") / F.col("_w")
    good = (F.col("_n") >= least_blocks) & (F.col("_c") >= least_text) & (F.col("_a") >= least_area) & (F.col("_w") > 0) & (covered >= least_covered) & (F.col("_m") == 0)
    return pages.where(good).select(*keys, covered.alias("covered"))
