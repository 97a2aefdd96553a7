"""Differences, drift and sinks by hand-made texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from concordia.functions import diff
from concordia.operators import drift
from concordia.sources import sinks


def test_changed_ranges_rebuild_the_text():
    """Putting the new text's ranges in place of the old ones gives the new text, white space apart."""
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc1 o0") for _ in range(rng.randrange(40))) for _ in range(2))
        out, at = [], 0
        for kind, i, j, k, m in diff.changed_ranges(a, b):
            assert kind == ("ADD" if i == j else "DELETE" if k == m else "MODIFY") and at <= i <= j and k <= m
            out += [a[at:i], b[k:m]]
            at = j
        fold = lambda t: "".join(diff._compact(t)[0].split())
        assert fold("".join([*out, a[at:]])) == fold(b)


def test_changed_ranges_by_hand():
    assert diff.changed_ranges("pay 100 now", "pay  200 now") == [("MODIFY", 4, 5, 5, 6)]
    assert diff.changed_ranges("3%o rate", "3‰ rate") == []
    assert diff.changed_ranges("1 Terms\nsame body text", "2 Terms\nsame body\ntext") == [("MODIFY", 0, 1, 0, 1)]
    assert diff.changed_ranges("", "x") == [("ADD", 0, 0, 0, 1)] and diff.changed_ranges("same", "same") == []


def test_compacted_column_equals_the_plain_one(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1%oO0.。 \t\n") for _ in range(rng.randrange(30))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", diff.compacted(F.col("t")).alias("c"))
    for r in frame.collect():
        assert (r.c.text, r.c.starts) == diff._compact(r.t)


@pytest.mark.parametrize(("a", "b", "want"), [("Model A100", "Model A100.", True), ("rate 5", "rate 6", False), ("abcdefghij", "abcdefghijl", True), ("abcdefghiO", "abcdefghi0", False), ("serviceOffer", "serviceofFer", False), ("contractOne", "contractone", True), ("", "x", False), ("not due", "due", False)])
def test_numeric_noise(a, b, want):
    assert diff.numeric_noise(a, b) is want


def test_spans_that_overlap_go_to_the_first(spark):
    schema = "pair long, id string, `order` long, section_type string, text string"
    needles = spark.createDataFrame([(1, "a", 1, "", "The buyer pays in May"), (1, "b", 2, "main_contract", "pays in May and June"), (1, "c", 3, "", "June and July also"), (1, "d", 4, "", "short"), (1, "e", 5, "appendix", "The buyer pays in May")], schema)
    hays = spark.createDataFrame([(1, "x", 1, "", "x: the BUYER pays  in May and June and July also.")], schema)
    rows = {r.id: (r.start, r.end) for r in drift.contained_spans(needles, hays).collect()}
    assert rows == {"a": (3, 25), "c": (30, 48)}
    merged = {r.id: r.slice_id for r in drift.merged_clauses(needles, hays).collect()}
    assert merged == {"a": "xM01", "c": "xM02"}
    assert drift.merged_clauses(needles.where("id = 'a'"), hays).collect() == []


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = sinks.artifact_path(str(tmp_path), "out", "rows.parquet")
    assert sinks.write_whole(spark.range(3), path).count() == 3
    with pytest.raises(Exception, match="(?i)divi"):
        sinks.write_whole(spark.range(3).selectExpr("assert_true(id < 2, 'division') as x", "id"), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["rows.parquet"]


@pytest.mark.parametrize("name", ["..", "a/b", "", ".hidden", "a..b", "/x", "a b"])
def test_names_that_lead_elsewhere_are_refused(name):
    with pytest.raises(ValueError, match="artifact"):
        sinks.artifact_path("/base", name)
