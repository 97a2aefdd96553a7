"""Scores of a candidate pair of clauses, 0 to 100, as columns: single scores, their weighted sum with its
caps and floors, the guard flags, and whether a candidate may be a match at all.

A pair is a row with the columns named in ``DETAILS``; null scores count as 0, a null coverage as 1. Everything is
a column expression, so a plan scores candidates within the stage that joins them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the rules read of a pair.
DETAILS = (
    "key_score", "path_score", "section_score", "number_score", "title_score", "body_score", "ratio_score", "partial_score", "coverage",
    "token_score", "position_score", "neighbor_score", "semantic_score", "rerank_score", "weak_marker", "path_mismatch",
)

# The share of each score in the weighted sum, and the thresholds that the rules share.
WEIGHTS = {"key_score": 0.16, "path_score": 0.05, "section_score": 0.10, "number_score": 0.14, "title_score": 0.18, "body_score": 0.32, "token_score": 0.07, "position_score": 0.06, "neighbor_score": 0.05}
SEMANTIC_WEIGHT, RERANK_WEIGHT = 0.08, 0.12
THRESHOLD, LIKELY, REVIEW_BELOW = 85.0, 78.0, 78.0
MAIN = "main_contract"
# Caps of the token and the partial score by the shorter text's share of the longer one. 100 is none.
SHORT_TEXT, SHORT_CAP = 8, 70.0
COVERAGE_CAPS = ((0.50, 76.0, 72.0), (0.70, 86.0, 82.0), (0.85, 100.0, 92.0))
# The fewest rule candidates that make a semantic search needless, and the rules that count.
SEMANTIC_LEAST = 3
STRONG_SOURCES = ("clause_no", "clause_key", "canonical_path", "body_top_k", "title_top_k")


def _of(name: str, none: float = 0.0) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(none))


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def type_of(section_type: Column) -> Column:
    return F.when(F.coalesce(section_type, F.lit("")) == "", MAIN).otherwise(section_type)


def body_score(full: Column, token: Column, partial: Column, short: Column, long: Column) -> Column:
    """The best of three scores; the loose ones are capped where one text is short or covers little of the other."""
    coverage = F.when(long > 0, short / long).otherwise(1.0)
    cap = [F.when(short < SHORT_TEXT, SHORT_CAP), F.when(short < SHORT_TEXT, SHORT_CAP)]
    for below, token_cap, partial_cap in COVERAGE_CAPS:
        cap = [c.when(coverage < below, v) for c, v in zip(cap, (token_cap, partial_cap), strict=True)]
    return F.greatest(full, F.least(token, cap[0].otherwise(100.0)), F.least(partial, cap[1].otherwise(100.0)))


def number_score(a: Column, b: Column, token: Column) -> Column:
    """100 for equal numbers, 70 for equal last part and depth, 40 for equal depth, else half of ``token``, the
    words' likeness of the two; 0 where one is missing."""
    parts = [F.split(F.coalesce(x, F.lit("")), r"\.") for x in (a, b)]
    same_depth = F.size(parts[0]) == F.size(parts[1])
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    tail = F.element_at(parts[0], -1) == F.element_at(parts[1], -1)
    return F.when(missing, 0.0).when(a == b, 100.0).when(same_depth & tail, 70.0).when(same_depth, 40.0).otherwise(0.5 * F.coalesce(token, F.lit(0.0)))


def key_score(a: Column, b: Column, same_type: Column, token: Column) -> Column:
    """Of clause keys or canonical paths: 100 if equal, 0 if one is missing or the section types differ, else the words' likeness."""
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, 0.0).when(a == b, 100.0).when(~same_type, 0.0).otherwise(token)


def parent(path: Column) -> Column:
    return F.array_join(F.slice(path, 1, F.greatest(F.lit(0), F.size(path) - 1)), "/")


def section_score(type_a: Column, type_b: Column, path_a: Column, path_b: Column, token: Column) -> Column:
    """0 across section types; 100 where neither has a parent section, 70 where one has, else the parents' likeness."""
    a, b = parent(path_a), parent(path_b)
    return F.when(type_of(type_a) != type_of(type_b), 0.0).when((a == "") & (b == ""), 100.0).when((a != "") & (b != ""), token).otherwise(70.0)


def section_path_mismatch(type_a: Column, type_b: Column, path_a: Column, path_b: Column) -> Column:
    """Same section type, different parent sections."""
    return (type_of(type_a) == type_of(type_b)) & (parent(path_a) != parent(path_b))


def section_mismatch_score(type_a: Column, type_b: Column, body: Column, number: Column, title: Column) -> Column:
    """How much a pair across section types looks like one clause that has moved; 0 within a type."""
    moved = F.greatest(body, F.when(number >= 100, 90.0).otherwise(0.0), F.when((title >= 92) & (body >= 80), 88.0).otherwise(0.0))
    return F.when(type_of(type_a) == type_of(type_b), 0.0).otherwise(moved)


def position_score(index_a: Column, count_a: Column, index_b: Column, count_b: Column) -> Column:
    """100 less 180 for a whole of difference between the places, each from 0 for the first to 1 for the last."""
    place = lambda i, n: i / F.greatest(F.lit(1), n - 1)
    return F.greatest(F.lit(0.0), 100.0 - 180.0 * F.abs(place(index_a, count_a) - place(index_b, count_b)))


def neighbor_score(before: Column, after: Column) -> Column:
    """The mean of the number scores of the clauses before and of those after; null where a side has none."""
    n = before.isNotNull().cast("int") + after.isNotNull().cast("int")
    return F.when(n == 0, 0.0).otherwise((F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))) / n)


def weak_numeric_marker(number_a: Column, number_b: Column, title_a: Column, title_b: Column, flagged: Column) -> Column:
    """Equal plain numbers with hardly a title, or a side that is flagged already."""
    bare = F.coalesce(number_a.rlike(r"^\s*\d+\s*$") & number_b.rlike(r"^\s*\d+\s*$") & (F.trim(number_a).cast("long") == F.trim(number_b).cast("long")), F.lit(False))
    short = lambda t: F.length(F.trim(F.coalesce(t, F.lit("")))) < 4
    return F.coalesce(flagged, F.lit(False)) | (bare & (short(title_a) | short(title_b)))


def alignment_flags(number_a: Column, number_b: Column, similarity: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """Flags of a pair whose numbers, text (``similarity``, 0 to 1) and critical tokens contradict one another."""
    both = (number_a != "") & (number_b != "")
    flags = F.array_compact(F.array(
        F.when(both & (number_a != number_b) & (similarity >= 0.78), "TEXT_MATCH_NUMBER_MISMATCH"),
        F.when(both & (number_a == number_b) & (similarity < 0.45), "TITLE_MATCH_TEXT_MISMATCH"),
        F.when((F.size(tokens_a) > 0) & (F.size(tokens_b) > 0) & (token_overlap(tokens_a, tokens_b) < 0.5), "CRITICAL_TOKEN_MISMATCH"),
    ))
    return F.when(F.size(flags) > 0, F.array_append(flags, "POSSIBLE_CLAUSE_MISALIGNMENT")).otherwise(flags)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared share of two token lists, four digits; two empty lists are the same, one is unlike any other."""
    share = F.bround(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 4)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def page_distance(pages_a: Column, pages_b: Column) -> Column:
    """Pages between two spans; 0 where they meet, null where one is empty."""
    gap = F.greatest(F.lit(0), F.array_min(pages_a) - F.array_max(pages_b), F.array_min(pages_b) - F.array_max(pages_a))
    return F.when((F.size(pages_a) > 0) & (F.size(pages_b) > 0), gap)


def guard_flags(alignment: Column, similarity: Column) -> Column:
    """What speaks against a candidate. ``alignment`` has the flags of ``alignment_flags``, ``similarity`` is 0 to 1."""
    body_only = (F.size(alignment) > 0) & (_of("key_score") < 96) & (_of("number_score") < 100) & (_of("body_score") >= min(THRESHOLD, LIKELY))
    return F.array_compact(F.array(
        F.when((_of("key_score") >= 96) & (_of("coverage", 1.0) < 0.70), "SAME_KEY_LOW_BODY_COVERAGE"),
        F.when(F.array_contains(alignment, "CRITICAL_TOKEN_MISMATCH"), "CRITICAL_TOKEN_CONFLICT"),
        F.when((_of("number_score") >= 100) & (F.coalesce(similarity, F.lit(1.0)) < 0.45), "SAME_NUMBER_LOW_BODY_SIMILARITY"),
        F.when(body_only, "BODY_ONLY_ALIGNMENT_RISK"),
        F.when(_of("path_mismatch") >= 1, "SECTION_PATH_MISMATCH_REVIEW"),
    ))


def weighted_score(flags: Column, overlap: Column) -> Column:
    """The weighted sum, raised where a strong sign stands and capped where a guard flag does. Two digits."""
    body, title, key, number = (_of(n) for n in ("body_score", "title_score", "key_score", "number_score"))
    total = reduce(lambda a, b: a + b, (_of(n) * w for n, w in WEIGHTS.items())) + _of("semantic_score") * SEMANTIC_WEIGHT + _of("rerank_score") * RERANK_WEIGHT
    total = F.when((_of("section_score") < 100) & (body < 90), F.least(total, F.lit(72.0))).otherwise(total)
    floor = (
        F.when((key == 100) & (body >= 45), 88.0 + F.least(F.lit(12.0), body * 0.12))
        .when((number == 100) & (title >= 90) & (body >= 45), 100.0)
        .when((number == 100) & ((body >= 55) | (title >= 80)), F.least(F.lit(100.0), 70.0 + body * 0.20 + title * 0.10))
        .when(body >= THRESHOLD, F.when(_of("token_score") < 45, body * 0.90).otherwise(body))
        .when((_of("semantic_score") >= 88) & (body >= 60), _of("semantic_score") * 0.92)
        .when(body >= min(THRESHOLD, LIKELY), body * 0.92)
        .otherwise(0.0)
    )
    has = lambda flag: F.array_contains(flags, flag)
    caps = F.least(
        F.when((_of("weak_marker") >= 1) & (body < 80) & (title < 75), 68.0).otherwise(100.0),
        F.when(has("SAME_KEY_LOW_BODY_COVERAGE"), 82.0).otherwise(100.0),
        F.when(has("CRITICAL_TOKEN_CONFLICT") & (F.coalesce(overlap, F.lit(1.0)) <= 0), 84.0).otherwise(100.0),
        F.when(has("SAME_NUMBER_LOW_BODY_SIMILARITY") & ((title < 80) | (_of("coverage", 1.0) < 0.5)), 78.0).otherwise(100.0),
        F.when(has("BODY_ONLY_ALIGNMENT_RISK"), 84.0).otherwise(100.0),
    )
    return F.bround(F.greatest(F.lit(0.0), F.least(F.greatest(total, floor), caps)), 2)


def acceptable(score: Column, flags: Column, same_number: Column, same_type: Column, short: Column, weak_titles: Column) -> Column:
    """Whether a candidate may be a match: no section type is crossed, no veto holds, and one reason does."""
    body, title, key, semantic = (_of(n) for n in ("body_score", "title_score", "key_score", "semantic_score"))
    mismatch_allowed = (_of("path_mismatch") >= 1) & _any((key >= 96) & (body >= 35), (_of("path_score") >= 96) & (body >= 45), same_number & (body >= 70), same_number & (title >= 80) & (body >= 55))
    weak, has = _of("weak_marker") >= 1, lambda flag: F.array_contains(flags, flag)
    vetoes = _any(
        (_of("section_score") < 100) & (body < 90) & (semantic < 88) & ~mismatch_allowed,
        weak & (_of("ratio_score") < 70) & ((title < 75) | weak_titles),
        weak & (body < 80) & (title < 75),
        has("SAME_KEY_LOW_BODY_COVERAGE") & (body < 55) & (title < 80),
        has("SAME_NUMBER_LOW_BODY_SIMILARITY") & (title < 80) & (score < REVIEW_BELOW),
    )
    by_number = (body >= 55) | (title >= 80) | (score >= REVIEW_BELOW)
    otherwise = _any(body >= THRESHOLD, (score >= min(THRESHOLD, LIKELY)) & (body >= 55), (title >= 92) & (body >= 55), (semantic >= 88) & (body >= 58), (_of("partial_score") >= 90) & (_of("coverage") >= 0.70) & (short >= 20))
    return same_type & ~vetoes & F.when((key >= 96) & (body >= 35), True).when(same_number, by_number).otherwise(otherwise)


def method(score: Column, same_number: Column, both_numbered: Column) -> Column:
    """The name of what a candidate rests on, the first that holds."""
    body, likely = _of("body_score"), score >= min(THRESHOLD, LIKELY)
    return (
        F.when((_of("section_score") < 100) & (_of("path_mismatch") < 1), "section_mismatch_blocked")
        .when(_of("key_score") >= 96, "same_clause_key_weighted")
        .when(same_number & (body < 55), "same_clause_no_low_similarity")
        .when(same_number, "same_clause_no_weighted")
        .when((_of("semantic_score") >= 88) & likely, "semantic_weighted_similarity")
        .when(both_numbered & (body >= 70), "renumbered_similarity")
        .when((_of("partial_score") >= 90) & (_of("coverage") >= 0.70), "partial_body_similarity")
        .when((_of("title_score") > body) & likely, "title_weighted_similarity")
        .otherwise("body_weighted_similarity")
    )


def confidence(score: Column, flags: Column, alignment: Column, method: Column, in_main: Column) -> Column:
    """LOW, MEDIUM or NORMAL, by the first rule that holds."""
    body, coverage = _of("body_score"), _of("coverage", 1.0)
    return (
        F.when((F.size(flags) > 0) | (F.size(alignment) > 0) | (score < REVIEW_BELOW) | (coverage < 0.50), "LOW")
        .when(coverage < 0.70, "MEDIUM")
        .when(_of("weak_marker") >= 1, F.when(body < 88, "LOW").otherwise("MEDIUM"))
        .when(~in_main, F.when(body >= 70, "MEDIUM").otherwise("LOW"))
        .when(method.isin("same_clause_no_low_similarity", "section_mismatch_blocked"), "LOW")
        .when((body < 65) & (_of("title_score") < 75), "MEDIUM")
        .otherwise("NORMAL")
    )


def semantic_gate(candidates: DataFrame, key: str, sources: str, always: bool = False, least: int = SEMANTIC_LEAST) -> DataFrame:
    """Keys for which the rules found too few strong candidates, so that a semantic search is worth its cost."""
    strong = F.arrays_overlap(F.col(sources), F.array(*[F.lit(s) for s in STRONG_SOURCES]))
    counted = candidates.groupBy(key).agg(F.count_if(strong).alias("strong"))
    return counted if always else counted.where(F.col("strong") < least)


def exhaustive_candidates(left: DataFrame, right: DataFrame, pair: str, most: int = 100) -> DataFrame:
    """All pairs of the two sides of a document pair, where these are fewer than ``most``; larger pairs are left to the
    prefilters. Both sides meet by ``pair``; columns other than that are prefixed l_ and r_."""
    sizes = left.groupBy(pair).agg(F.count("*").alias("_n")).join(right.groupBy(pair).agg(F.count("*").alias("_m")), pair).where(F.col("_n") * F.col("_m") < most)
    one = left.select(pair, *[F.col(c).alias(f"l_{c}") for c in left.columns if c != pair])
    two = right.select(pair, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != pair])
    return sizes.select(pair).join(one, pair).join(two, pair)


def relationship_score(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``page_score``: the best score of an alignment entry of the pair's documents that meets the pages of both sides.

    ``pairs``: pair, id, original_pages, compare_pages. ``entries``: pair, status, original_pages, compare_pages, score.
    """
    good = entries.where(F.col("status").isin("MATCHED", "MERGED", "SPLIT")).select("pair", F.col("original_pages").alias("_o"), F.col("compare_pages").alias("_c"), F.col("score").alias("_s"))
    hit = F.when(F.arrays_overlap("original_pages", "_o") & F.arrays_overlap("compare_pages", "_c"), F.col("_s"))
    best = pairs.join(good, "pair").groupBy("pair", "id").agg(F.max(hit).alias("page_score"))
    return pairs.join(best, ["pair", "id"], "left").withColumn("page_score", F.coalesce("page_score", F.lit(0.0)))
