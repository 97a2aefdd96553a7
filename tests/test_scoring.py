"""Scoring rules by hand-made pairs; the values are worked out from the rules, not from the code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from concordia.operators import scoring


@pytest.mark.parametrize(
    ("full", "token", "partial", "short", "long", "want"),
    [(50, 95, 90, 5, 100, 70), (50, 95, 90, 40, 100, 76), (50, 60, 90, 40, 100, 72), (50, 95, 90, 60, 100, 86), (50, 60, 90, 60, 100, 82), (50, 60, 95, 80, 100, 92), (50, 95, 60, 80, 100, 95), (50, 95, 99, 90, 100, 99), (97, 95, 90, 5, 100, 97), (0, 0, 0, 0, 0, 0)],
)
def test_body_score(spark, full, token, partial, short, long, want):
    of = [F.lit(float(v)) for v in (full, token, partial)] + [F.lit(short), F.lit(long)]
    assert spark.range(1).select(scoring.body_score(*of)).head()[0] == want


@pytest.mark.parametrize(("a", "b", "token", "want"), [("1.2", "1.2", 0, 100), ("1.2", "3.2", 0, 70), ("1.2", "1.3", 0, 40), ("1.2", "1.2.1", 75, 37.5), ("", "1", 90, 0), (None, "1", 90, 0)])
def test_number_score(spark, a, b, token, want):
    frame = spark.createDataFrame([(a, b, float(token))], "a string, b string, t double")
    assert frame.select(scoring.number_score(F.col("a"), F.col("b"), F.col("t"))).head()[0] == want


def pair(spark, **scores):
    row = {"section_score": 100.0, "coverage": 1.0, "token_score": 100.0} | scores
    schema = ", ".join(f"{n} double" for n in scoring.DETAILS)
    return spark.createDataFrame([tuple(float(row.get(n, 0.0)) for n in scoring.DETAILS)], schema)



def no_flags():
    return F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("scores", "flags", "want"),
    [
        ({"key_score": 100, "body_score": 50}, [], 94.0),  # 88 + 50 * 0.12
        ({"number_score": 100, "title_score": 90, "body_score": 45}, [], 100.0),
        ({"number_score": 100, "title_score": 50, "body_score": 60}, [], 87.0),  # 70 + 12 + 5
        ({"body_score": 90}, [], 90.0),
        ({"body_score": 90, "token_score": 20}, [], 81.0),
        ({"body_score": 80}, [], 73.6),
        ({"key_score": 100, "body_score": 95}, ["SAME_KEY_LOW_BODY_COVERAGE"], 82.0),
        ({"body_score": 90}, ["BODY_ONLY_ALIGNMENT_RISK"], 84.0),
        ({}, [], 17.0),  # section 10 and token 7
    ],
)
def test_weighted_score(spark, scores, flags, want):
    given = F.array(*[F.lit(f) for f in flags]) if flags else no_flags()
    assert pair(spark, **scores).select(scoring.weighted_score(given, F.lit(1.0))).head()[0] == pytest.approx(want)


def test_acceptance(spark):
    yes, no = F.lit(True), F.lit(False)
    judged = lambda score, same_number, same_type=yes, **s: pair(spark, **s).select(scoring.acceptable(F.lit(float(score)), no_flags(), same_number, same_type, F.lit(50), no)).head()[0]
    assert judged(90, no, body_score=90) and not judged(90, no, no, body_score=90)
    assert judged(50, no, key_score=96, body_score=35) and not judged(50, no, key_score=96, body_score=34)
    assert judged(50, yes, body_score=55) and not judged(50, yes, body_score=54)
    assert not judged(80, no, body_score=80, weak_marker=1, ratio_score=60) and not judged(95, no, body_score=79, weak_marker=1, ratio_score=80)
    assert not judged(90, no, body_score=89, section_score=70) and judged(90, yes, body_score=89, section_score=70, path_mismatch=1)


def test_alignment_flags(spark):
    frame = spark.createDataFrame([("1", "2", 0.8, ["a"], ["a"]), ("1", "1", 0.4, ["a"], ["b"]), ("", "1", 0.9, [], ["b"])], "a string, b string, s double, x array<string>, y array<string>")
    rows = frame.select(scoring.alignment_flags(*(F.col(c) for c in "absxy")).alias("f")).collect()
    last = "POSSIBLE_CLAUSE_MISALIGNMENT"
    assert [r.f for r in rows] == [["TEXT_MATCH_NUMBER_MISMATCH", last], ["TITLE_MATCH_TEXT_MISMATCH", "CRITICAL_TOKEN_MISMATCH", last], []]


@pytest.mark.parametrize("tile", [2, 3, 1024])
def test_vector_pairs_against_brute_force(spark, monkeypatch, tile):
    import numpy as np

    from concordia.operators import matching

    monkeypatch.setattr(matching, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows = [(i, int(i % 2), [float(v) for v in rng.integers(-3, 4, 3)]) for i in range(17)] + [(90, 0, None), (91, None, [1.0, 2.0, 3.0]), (92, 1, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, b int, v array<float>")
    live = [(i, b, np.array(v)) for i, b, v in rows if v is not None and b is not None and any(v)]
    want = {(i, j, round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6) + 0.0) for i, b, x in live for j, c, y in live if i != j and b == c}
    got = {(r.left, r.right, r.score + 0.0) for r in matching.vector_pairs(frame, "b", "id", "v").collect()}
    assert {(i, j) for i, j, _ in got} == {(i, j) for i, j, _ in want} and all(abs(dict(((i, j), s) for i, j, s in want)[i, j] - s) < 2e-6 for i, j, s in got)
    best = {}
    for i, j, s in got:
        best.setdefault(i, []).append((-s, j))
    top = {(r.left, r.right, r["rank"]) for r in matching.vector_pairs(frame, "b", "id", "v", 3).collect()}
    assert top == {(i, j, n + 1) for i, found in best.items() for n, (_, j) in enumerate(sorted(found)[:3])}
