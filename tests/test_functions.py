from __future__ import annotations

import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concordia.functions import normalize, numbering, similarity, values
from concordia.operators import aggregates, cells, evidence, lifecycle, lines, matching
from concordia.plans import matching_queries


def column(spark, texts, make):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("t")).alias("x")).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  A\tB  \r\n第 3 页\n合同编号：X-1\nＣ１\n\n", "A B\nC1"),
        ("ﬁne ﬄ", "fine ffl"),
        ("共 10 页 第 2 页\nx", "x"),
        (None, ""),
        (" \n ", ""),
    ],
)
def test_normalize(spark, text, want):
    assert column(spark, [text], normalize.normalize) == [want]


def test_match_and_diff_folds(spark):
    texts = ["Pay 1,234,567.5, now!", "（2024） 12号", "二零二0年", "价格：3,50"]
    assert column(spark, texts, normalize.normalize_for_match) == ["pay12345675now", "202412号", "二〇二〇年", "价格350"]
    assert column(spark, texts, normalize.normalize_for_diff) == ["pay1234567.5,now", "202412号", "二〇二〇年", "价格3,50"]


def test_shorten_and_fold(spark):
    assert column(spark, ["a  b", "x" * 300, None], normalize.shorten) == ["a b", "x" * 220 + "...", ""]
    assert column(spark, ["a-b_c, é!"], normalize.punctuation_fold) == ["abcé"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("第十二条 付款", ("formal", "第十二条", "12", 3)),
        ("第3章 总则", ("formal", "第3章", "3", 1)),
        ("二十一、范围", ("chinese_list", "二十一", "21", 1)),
        ("（三）期限", ("parenthesized", "(三)", "3", 4)),
        ("3.2.1 Scope", ("decimal", "3.2.1", "3.2.1", 3)),
        ("7. Term", ("decimal", "7", "7", 1)),
        ("③ x", ("circled", "③", "3", 5)),
        ("plain text", None),
    ],
)
def test_markers(spark, line, want):
    found = column(spark, [line], numbering.marker)[0]
    assert (tuple(found) if found else None) == want


def test_chinese_numerals(spark):
    wanted = {"十": 10, "一百零五": 105, "三千二百": 3200, "一万二千": 12000, "二〇二四": 2024, "两百": 200, "x": None}
    assert column(spark, list(wanted), numbering.chinese_to_int) == list(wanted.values())


def test_plain_numbers_are_no_clauses(spark):
    texts = ["", "12", "2024-01-02", "30 天内付款", "5-7 days", "123 Main", "第1条", "3.2 Scope"]
    assert column(spark, texts, numbering.is_plain_number) == [True, True, True, True, True, True, False, False]


def test_typed_cells(spark):
    texts = ["2024年3月5日", "５ ％", "12台", "¥1,234.5", "1.5万元", "3月", "as  agreed", "-7"]
    want = ["date:2024-03-05", "percent:5.0000", "quantity:12.0000台", "amount:1234.50", "amount:15000.00", "quantity:3.0000月", "as agreed", "amount:-7.00"]
    assert column(spark, texts, values.typed_cell) == want


def test_similarity_against_definitions():
    rng = random.Random(1)

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.ratio("", "") == 100 and similarity.ratio("", "x") == 0
    assert similarity.partial_ratio("abc", "xxabcxx") == 100
    assert similarity.token_set_ratio("b a", "a b c") == 100


def test_change_ranges_rebuild_the_text():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rng.choice("ab cd") for _ in range(rng.randint(0, 40))) for _ in range(2))
        out, at = "", 0
        for _, i, j, k, m in similarity.change_ranges(a, b):
            out += a[at:i] + b[k:m]
            at = j
        assert out + a[at:] == b
    assert difflib.SequenceMatcher(None, "x", "x").ratio() * 100 == similarity.sequence_ratio("x", "x")


def test_assignment():
    rows = pd.DataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (3, 12, 0.1)], columns=["left", "right", "score"])
    assert sorted(zip(*matching.greedy_rows(rows)[["left", "right"]].T.values, strict=True)) == [(1, 10), (3, 12)]
    best = matching.optimal_rows(rows.assign(score=rows.score * 100))
    assert sorted(zip(best.left, best.right, strict=True)) == [(1, 11), (2, 10), (3, 12)]


@pytest.mark.parametrize("seed", range(5))
def test_optimal_assignment_against_brute_force(seed):
    rng = random.Random(seed)
    rows = pd.DataFrame([(i, j, rng.randint(1, 99)) for i in range(4) for j in range(4) if rng.random() < 0.6], columns=["left", "right", "score"])
    edges = list(rows.itertuples(index=False))
    best = max(((len(c), sum(e.score for e in c)) for n in range(5) for c in itertools.combinations(edges, n) if len({e.left for e in c}) == len({e.right for e in c}) == n), default=(0, 0))
    found = matching.optimal_rows(rows)
    assert (len(found), found.score.sum()) == best


def test_page_alignment():
    pages = [f"page{i} " + " ".join(f"w{i}{j}" for j in range(20)) for i in range(5)]
    status = lambda a, b: [r[0] for r in matching.aligned_pages(a, b)]
    assert status(pages, pages) == ["MATCHED"] * 5
    assert status(pages, pages[:2] + pages[3:]) == ["MATCHED", "MATCHED", "DELETED", "MATCHED", "MATCHED"]
    assert status(pages[:2], [pages[0], "quite new words here", pages[1]]) == ["MATCHED", "ADDED", "MATCHED"]
    assert status(pages[:2], [f"{pages[0]} {pages[1]}"]) == ["MERGED"]
    assert status([f"{pages[0]} {pages[1]}"], pages[:2]) == ["SPLIT"]
    assert matching.aligned_pages([], []) == [] and status([], pages[:1]) == ["ADDED"]


def test_row_alignment():
    assert matching.lcs_rows(["a b", "c d"], ["a b", "x y z", "c d"]) == [(0, 0, 1.0), (None, 1, 0.0), (1, 2, 1.0)]
    assert matching.lcs_rows([], ["a"]) == [(None, 0, 0.0)]


def test_changes_count_and_unknown_status_fails(spark):
    frame = spark.createDataFrame([(1, "ADD"), (1, "MATCH"), (1, "MODIFY"), (2, "DELETE")], "k int, status string")
    assert sorted(map(tuple, aggregates.count_changes(frame, ["k"]).collect())) == [(1, 1, 0, 1, 2), (2, 0, 1, 0, 1)]
    with pytest.raises(Exception, match="unsupported change status"):
        aggregates.count_changes(spark.createDataFrame([(1, "ODD")], "k int, status string"), ["k"]).collect()


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    boxes = [("p", i, x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + rng.uniform(1, 30), y + rng.uniform(1, 30)) for i in range(80)]
    frame = spark.createDataFrame(boxes, "k string, i int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for a, b in itertools.combinations(boxes, 2):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        if w > 0 and h > 0 and w * h >= 0.5 * min((z[4] - z[2]) * (z[5] - z[3]) for z in (a, b)):
            want.add((a[1], b[1]))
    assert {tuple(r) for r in aggregates.overlap_pairs(frame, ["k"], "i", 0.5, 13.0).collect()} == want


def test_html_tables_with_spans(spark):
    html = '<table><tr><th colspan="2">A</th><td rowspan="2">B</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>'
    frame = spark.createDataFrame([(1, html)], "id int, html string")
    grid = {(r["row"], r["col"]): (r["text"], r["anchor"]) for r in cells.expand_spans(cells.html_cells(frame, "id", "html"), "id").collect()}
    assert grid == {(0, 0): ("A", True), (0, 1): ("A", False), (0, 2): ("B", True), (1, 2): ("B", False), (1, 0): ("c", True), (1, 1): ("d", True), (2, 0): ("e", True)}


def test_observation_matrix(spark):
    states = ["OBSERVED_VALUE", "OBSERVED_BLANK", "UNOBSERVED"]
    rows = [(a, b, e, r, m) for a in states for b in states for e in (True, False) for r in (True, False) for m in (True, False)]
    frame = spark.createDataFrame(rows, "original_state string, compare_state string, values_equal boolean, content_reliable boolean, removed boolean")
    found = lifecycle.observation_decision(frame).collect()
    assert len(found) == len(rows) and {r.decision for r in found if "UNOBSERVED" in (r.original_state, r.compare_state) and not r.removed} == {"NEEDS_REVIEW"}
    assert {r.reason for r in found if r.removed and r.content_reliable and (r.original_state, r.compare_state) == ("OBSERVED_VALUE", "UNOBSERVED")} == {"BUSINESS_CONTENT_REMOVED_OR_COVERED"}


def test_segments_islands_and_paths(spark):
    units = spark.createDataFrame([(1, 0, "a"), (1, 1, "# b"), (1, 2, "c"), (1, 3, "# d")], "k int, n int, t string")
    found = lines.segments(units, ["k"], "n", F.col("t").startswith("#"), "t").orderBy("clause_seq").collect()
    assert [r.text for r in found] == ["a", "# b\nc", "# d"]
    runs = lines.islands(spark.createDataFrame([(1, v) for v in (1, 2, 3, 5, 6, 9, 10, 11)], "k int, v int"), ["k"], F.col("v"), 3)
    assert sorted((r["first"], r["last"]) for r in runs.collect()) == [(1, 3), (9, 11)]


def test_windows_and_codes(spark):
    frame = spark.createDataFrame([(p,) for p in range(1, 30)], "p int").select("p", evidence.windows_of(F.col("p"), 10, 1).alias("w"))
    for p, w in frame.collect():
        assert w == [k for k in range(5) if 9 * k + 1 <= p <= 9 * k + 10]
    codes = spark.createDataFrame([("A0B", "AOB"), ("A0B", "A0B"), ("A0B", "AXB"), ("A05", "AOS"), ("A", "AB")], "a string, b string")
    assert [r[0] for r in codes.select(evidence.ambiguous_codes(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_lcs_of_long_texts_is_fast():
    a = "".join(random.Random(1).choices("abcdef", k=4000))
    assert similarity.lcs_length(a, a[::-1]) > 1000 and np.isfinite(similarity.ratio(a, a[::-1]))


def test_best_lines_against_all_pairs(spark, tmp_path):
    """Lines without three common words, short ones and ties are scored like all others."""
    rng = random.Random(4)
    words = ["payment", "is", "due", "within", "thirty", "days", "of", "receipt", "ok", "no", "中文", "notice"]
    passages = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(40, ""), (41, None), (42, "x" * 70)]
    lines = []
    for _, p in passages[:40]:
        w = p.split(" ")
        lines += [" ".join(x + "s" if i % 3 == 2 else x for i, x in enumerate(w)), p[::-1], p[:7]]
    lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 20))) for _ in range(200)] + ["x" * 69, "x" * 400, "y" * 900]
    docs = [(i, "\n".join(lines[i::7])) for i in range(7)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {}
    for r in sorted(matching_queries.fuzzy_topk_ratio(spark, str(tmp_path)).collect(), key=lambda r: (r.item_id, r["rank"])):
        found.setdefault(r.item_id, []).append((r.score, r.line))
    want = {}
    for i, p in passages:
        scored = sorted((-round(similarity.ratio(p or "", x), 4), x) for x in {x.strip() for x in lines} - {""})
        if top := [(-s, x) for s, x in scored if -s >= 30][:5]:
            want[i] = top
    assert found == want


@pytest.mark.parametrize("optimal", [False, True])
def test_assignment_of_vectors_against_all_pairs(spark, optimal):
    """Copies, vectors of length 0, negative ids, and an id that stands in two labels."""
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], i % 3) for i in range(-9, 60)] + [(100 + i, [1.0, 0.0, 1.0], 1) for i in range(9)]
    rows += [(4, [1.0, 2.0, 0.5], 2), (7, [0.0, 2.0, 0.5], 2), (8, None, 0), (None, [1.0, 1.0, 1.0], 0), (11, [1.0, 1.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {}
    for r in matching.assign_vectors(frame, "label", "vec_id", "embedding", optimal).collect():
        found.setdefault(r.block, []).append((r.left, r.right, r.score))
    pairs = matching.vector_pairs(frame, "label", "vec_id", "embedding")
    for label in range(3):
        of = {i for i, _, at in rows if at == label}
        scored = matching.vector_pairs(frame.where(F.col("label") == label), "label", "vec_id", "embedding").where("left % 2 = 0 and right % 2 = 1").toPandas()
        assert set(scored.left) <= of and pairs.count() > len(scored)
        want = matching.optimal_rows(scored.assign(score=scored.score * 100)) if optimal else matching.greedy_rows(scored)
        if optimal:
            assert (len(found[label]), round(sum(s for *_, s in found[label]), 4)) == (len(want), round(want.score.sum() / 100, 4))
        else:
            assert sorted(found[label]) == sorted(zip(want.left, want.right, want.score, strict=True))


@pytest.mark.parametrize("name", ["greedy_assignment", "optimal_assignment"])
def test_assignment_queries_keep_labels_apart(spark, tmp_path, name):
    """An id that two labels hold pairs within either of them."""
    rows = [(2, [1.0, 0.0], 0), (3, [1.0, 0.1], 0), (2, [0.0, 1.0], 1), (5, [0.1, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = matching_queries.QUERIES[name][0](spark, str(tmp_path))
    assert sorted((r.pair, r.left, r.right) for r in found.collect()) == [(0, 2, 3), (1, 2, 5)]


def test_optimal_vectors_without_held_costs(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(25, 4))
    held = matching.optimal_vectors(np.arange(30) * 2, x, np.arange(25) * 2 + 1, y)
    monkeypatch.setattr(matching, "HELD", 10)
    assert sorted(matching.optimal_vectors(np.arange(30) * 2, x, np.arange(25) * 2 + 1, y)) == sorted(held) and len(held) == 25


def test_counterparts_on_shared_places(spark):
    """All pairs decide, but blocks and regions on one place meet once: 30,000 on each side, 900 million pairs."""
    rng = random.Random(8)
    place = lambda i: (i, float(rng.randint(0, 9)), float(rng.randint(0, 9)))
    regions, blocks = [place(i % 50) for i in range(60)], [place(i) for i in range(40)] + [(None, 3.0, 3.0), (90, None, 1.0), (91, -2.0, 30.0)]
    kind = "{} long, x double, y double".format
    for margin in (0.05, 0.0):
        want = set()
        for r in range(50):
            near = sorted((-round(1 - (dx + dy) / 6, 6), -1 if b is None else b) for i, x, y in regions if i == r for b, u, v in blocks if u is not None and (dx := abs(x - u)) <= 3 and (dy := abs(y - v)) <= 3)
            if near and (len(near) == 1 or near[1][0] - near[0][0] >= margin):
                want.add((r, None if near[0][1] < 0 else near[0][1], -near[0][0]))
        found = evidence.counterparts(spark.createDataFrame(regions, kind("region")), spark.createDataFrame(blocks, kind("block")), "region", "block", 3.0, margin)
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and want
    many = lambda name, x: spark.range(30_000).select(F.col("id").alias(name), F.lit(x).alias("x"), F.lit(1.0).alias("y"))
    near = evidence.counterparts(many("region", 0.0), many("block", 1.0).unionByName(spark.createDataFrame([(-7, 0.0, 1.0)], kind("block"))), "region", "block", 3.0, 0.05)
    assert near.groupBy("block", "score").count().collect() == [(-7, 1.0, 30_000)]


def test_overlaps_of_equal_boxes(spark, monkeypatch):
    """Many copies of a few boxes, repeated and missing ids: every pair of ids by its times, and each two boxes meet once."""
    rng = random.Random(5)
    shapes = [(x := rng.randint(0, 30), y := rng.randint(0, 30), x + rng.randint(0, 12), y + rng.randint(1, 9)) for _ in range(12)]
    boxes = [(rng.choice(["p", "q", None]), i % 190 if i else None, *map(float, rng.choice(shapes))) for i in range(200)] + [("p", 7, None, 1.0, 2.0, 2.0)]
    frame = spark.createDataFrame(boxes, "k string, i int, x0 double, y0 double, x1 double, y1 double")
    want = []
    for a, b in itertools.product(boxes, repeat=2):
        if a[0] and a[0] == b[0] and None not in (*a, *b) and a[1] < b[1]:
            w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
            if w > 0 and h > 0 and w * h >= 0.5 * min((z[4] - z[2]) * (z[5] - z[3]) for z in (a, b)):
                want.append((a[1], b[1]))
    for together in (256, 3):
        monkeypatch.setattr(aggregates, "TOGETHER", together)
        assert sorted(map(tuple, aggregates.overlap_pairs(frame, ["k"], "i", 0.5, 13.0).collect())) == sorted(want)
    found = aggregates.overlap_pairs(spark.range(2_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 5.0), ("y1", 5.0))]), ["k"], "i", 0.5, 13.0)
    assert found.count() == 1_999_000 and "l__ids" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["page_quality_status", "page_quality_rollup", "page_risk_join"])
def test_means_do_not_depend_on_splits(spark, tmp_path, name):
    """Orders whose mean discount lies on the limit, their rows in files that are read apart: sums follow the rows' order."""
    import duckdb

    from concordia.plans import catalogue

    rng = random.Random(9)
    rows = [(order, d, 20.0, 0.01) for order in range(300) for d in rng.choice([(0.01, 0.01, 0.01, 0.09), (0.01, 0.01, 0.04, 0.06), (0.0, 0.0, 0.01, 0.02, 0.06, 0.09), (0.01, 0.02, 0.02, 0.04, 0.06)])]
    rng.shuffle(rows)
    for part in range(5):
        frame = pd.DataFrame(rows[part :: 5] if part % 2 else rows[part :: 5][::-1], columns=["l_orderkey", "l_discount", "l_quantity", "l_tax"])
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        frame.to_parquet(tmp_path / "lineitem.parquet" / f"part-{part}.parquet", index=False)
    spark.createDataFrame([(i, i % 20) for i in range(300)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, 7) for i in range(300)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("set threads=1")
    for t in ("lineitem", "orders", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    query, sql = catalogue()[name]
    want = con.sql(sql)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        found = query(spark, str(tmp_path)).select(*want.columns).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want.fetchall()))


def test_means_follow_the_names_of_files(spark, tmp_path):
    """Files whose names a URI writes in another way: their rows come in the order of the names themselves."""
    import duckdb

    from concordia.plans import catalogue
    from concordia.sources.tables import ordered_table

    rng = random.Random(4)
    rows = [(order, d, 20.0, 0.01) for order in range(300) for d in rng.choice([(0.01, 0.01, 0.01, 0.09), (0.01, 0.01, 0.04, 0.06), (0.0, 0.0, 0.01, 0.02, 0.06, 0.09), (0.01, 0.02, 0.02, 0.04, 0.06)])]
    rng.shuffle(rows)
    names = ["a b", "a!b", "a#b", "a%b", "a%20b", "a+b", "a-b", "a", "B", "é"]
    (tmp_path / "lineitem.parquet").mkdir()
    for i, name in enumerate(names):
        pd.DataFrame(rows[i :: len(names)], columns=["l_orderkey", "l_discount", "l_quantity", "l_tax"]).to_parquet(tmp_path / "lineitem.parquet" / f"{name}.parquet", index=False)
    files = ordered_table(spark, str(tmp_path), "lineitem", "l_orderkey").select("_file").distinct().orderBy("_file").collect()
    assert [f.rpartition("/")[2] for (f,) in files] == sorted(f"{name}.parquet" for name in names)
    con = duckdb.connect()
    con.sql("set threads=1")
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    query, sql = catalogue()["page_quality_status"]
    want = con.sql(sql)
    found = query(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want.fetchall()))
