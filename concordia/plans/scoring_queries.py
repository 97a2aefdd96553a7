"""Queries of candidate scoring. Parts stand for candidate pairs: their scores come from the part number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.operators import scoring as op
from concordia.sources.tables import table

#: Each score of a pair is its number modulo this, stretched to 0 to 100.
_MODULI = {"key_score": 2, "path_score": 3, "section_score": 4, "number_score": 5, "title_score": 7, "body_score": 11, "ratio_score": 12, "partial_score": 10, "token_score": 13, "position_score": 17, "neighbor_score": 19, "semantic_score": 23}
_MISALIGNED = "POSSIBLE_CLAUSE_MISALIGNMENT"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    # The place is a little less, so that no sum is a tie between two roundings.
    scores = {name: (k % m) * (99.93 if name == "position_score" else 100.0) / (m - 1) for name, m in _MODULI.items()}
    alignment = F.when(k % 5 == 1, F.array(F.lit("CRITICAL_TOKEN_MISMATCH"), F.lit(_MISALIGNED))).when(k % 7 == 2, F.array(F.lit("TEXT_MATCH_NUMBER_MISMATCH"), F.lit(_MISALIGNED))).otherwise(F.array().cast("array<string>"))
    rest = {"coverage": (k % 9) / 8.0, "rerank_score": F.lit(0.0), "weak_marker": (k % 6 == 0).cast("int"), "path_mismatch": (k % 8 == 0).cast("int"), "similarity": (k % 16) / 15.0, "overlap": (k % 3) / 2.0, "alignment": alignment}
    pairs = table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in (scores | rest).items()])
    pairs = pairs.withColumn("flags", op.guard_flags(F.col("alignment"), F.col("similarity")))
    pairs = pairs.withColumn("score", op.weighted_score(F.col("flags"), F.col("overlap")))
    return pairs.withColumn("method", op.method(F.col("score"), k % 4 == 1, k % 3 > 0))


_PAIRS = """p as (select p_partkey as k, (p_partkey % 2) * 100.0::double as key, (p_partkey % 3) * 100.0::double / 2 as path, (p_partkey % 4) * 100.0::double / 3 as section, (p_partkey % 5) * 100.0::double / 4 as number,
  (p_partkey % 7) * 100.0::double / 6 as title, (p_partkey % 11) * 100.0::double / 10 as body, (p_partkey % 12) * 100.0::double / 11 as ratio, (p_partkey % 10) * 100.0::double / 9 as partial, (p_partkey % 13) * 100.0::double / 12 as token,
  (p_partkey % 17) * 99.93::double / 16 as position, (p_partkey % 19) * 100.0::double / 18 as neighbor, (p_partkey % 23) * 100.0::double / 22 as semantic, (p_partkey % 9) / 8.0::double as coverage,
  p_partkey % 6 = 0 as weak, p_partkey % 8 = 0 as mismatch, (p_partkey % 16) / 15.0::double as similarity, p_partkey % 3 = 0 as no_overlap, p_partkey % 5 = 1 as critical, p_partkey % 5 = 1 or p_partkey % 7 = 2 as misaligned, p_partkey % 4 = 1 as same_number from part),
f as (select *, key >= 96 and coverage < 0.7 as f1, critical as f2, number >= 100 and similarity < 0.45 as f3, misaligned and key < 96 and number < 100 and body >= 78 as f4, mismatch as f5 from p),
t as (select *, key * 0.16::double + path * 0.05::double + section * 0.10::double + number * 0.14::double + title * 0.18::double + body * 0.32::double + token * 0.07::double + position * 0.06::double + neighbor * 0.05::double + semantic * 0.08::double as t0 from f),
u as (select *, case when section < 100 and body < 90 and t0 > 72 then 72 else t0 end as t1, case when key = 100 and body >= 45 then 88 + least(12, body * 0.12::double) when number = 100 and title >= 90 and body >= 45 then 100
  when number = 100 and (body >= 55 or title >= 80) then least(100, 70 + body * 0.2::double + title * 0.1::double) when body >= 85 then case when token < 45 then body * 0.9::double else body end
  when semantic >= 88 and body >= 60 then semantic * 0.92::double when body >= 78 then body * 0.92::double else 0 end as lift from t),
s as (select *, round_even(greatest(0::double, least(greatest(t1, lift), case when weak and body < 80 and title < 75 then 68 else 100 end, case when f1 then 82 else 100 end, case when f2 and no_overlap then 84 else 100 end,
  case when f3 and (title < 80 or coverage < 0.5) then 78 else 100 end, case when f4 then 84 else 100 end)), 2)::double as score from u),
m as (select *, case when section < 100 and not mismatch then 'section_mismatch_blocked' when key >= 96 then 'same_clause_key_weighted' when same_number and body < 55 then 'same_clause_no_low_similarity' when same_number then 'same_clause_no_weighted'
  when semantic >= 88 and score >= 78 then 'semantic_weighted_similarity' when k % 3 > 0 and body >= 70 then 'renumbered_similarity' when partial >= 90 and coverage >= 0.7 then 'partial_body_similarity'
  when title > body and score >= 78 then 'title_weighted_similarity' else 'body_weighted_similarity' end as method from s)"""


def match_risk_flags(spark: SparkSession, d: str) -> DataFrame:
    """Guard flags, method and confidence of scored pairs."""
    pairs = _pairs(spark, d)
    sure = op.confidence(F.col("score"), F.col("flags"), F.col("alignment"), F.col("method"), F.col("p_partkey") % 10 != 3)
    return pairs.select("p_partkey", F.array_join("flags", ",").alias("flags"), "method", sure.alias("confidence"))


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("p_partkey", "score")


def candidate_acceptance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    accepted = op.acceptable(F.col("score"), F.col("flags"), k % 4 == 1, k % 9 != 0, k % 30, k % 2 == 1)
    return _pairs(spark, d).select("p_partkey", accepted.alias("accepted"))


def body_score_caps(spark: SparkSession, d: str) -> DataFrame:
    """Loose scores are capped where the shorter text is short or covers little of the longer one."""
    k, size = F.col("p_partkey"), F.col("p_size")
    score = op.body_score(size * 2.0, k % 101 * 1.0, k % 97 * 1.0, size, size + k % 40)
    return table(spark, d, "part").select("p_partkey", score.alias("body_score"))


def _number(depth: Column, *parts: Column) -> Column:
    return F.array_join(F.slice(F.array(*[p.cast("string") for p in parts]), 1, depth), ".")


def clause_number_score(spark: SparkSession, d: str) -> DataFrame:
    """Clause numbers of one to three parts, or none, and a given likeness of their words."""
    k = F.col("p_partkey")
    a, b = _number((k % 4).cast("int"), k % 3, k % 5, k % 2), _number((k % 7 % 4).cast("int"), k % 2, k % 3, k % 2)
    return table(spark, d, "part").select("p_partkey", op.number_score(a, b, k % 41 * 2.5).alias("score"))


def section_scores(spark: SparkSession, d: str) -> DataFrame:
    """Section types and paths of two sides: likeness of the parents, key scores, and what looks moved."""
    k = F.col("p_partkey")
    type_a, type_b = F.when(k % 3 == 0, "appendix").when(k % 3 == 1, ""), F.when(k % 5 == 0, "appendix").otherwise("main_contract")
    path_a, path_b = (F.slice(F.array(*[F.lit(x) for x in names]), 1, (k % m).cast("int")) for names, m in ((("I", "a", "x"), 4), (("I", "b", "x"), 3)))
    token, body, number, title = k % 50 * 2.0, k % 101 * 1.0, F.when(k % 4 == 0, 100.0).otherwise(40.0), k % 100 * 1.0
    same = op.type_of(type_a) == op.type_of(type_b)
    return table(spark, d, "part").select(
        "p_partkey", op.section_score(type_a, type_b, path_a, path_b, token).alias("section"), op.section_path_mismatch(type_a, type_b, path_a, path_b).alias("mismatch"),
        op.section_mismatch_score(type_a, type_b, body, number, title).alias("moved"), op.key_score((k % 3).cast("string"), F.when(k % 7 > 0, (k % 2).cast("string")), same, token).alias("key"),
    )


def alignment_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Flags, token overlap and page distance of two versions of an order."""
    k = F.col("o_orderkey")
    numbers = F.when(k % 4 > 0, (k % 3).cast("string")).otherwise(""), F.when(k % 5 > 0, (k % 2).cast("string")).otherwise("")
    similarity = (k % 21) / 20.0
    lists = [F.filter(F.array(*[F.when(k % m == r, F.lit(t)) for m, r, t in parts]), lambda x: x.isNotNull()) for parts in (((2, 0, "30%"), (3, 0, "USD5"), (5, 1, "2020-01-01")), ((2, 0, "30%"), (4, 1, "USD6"), (5, 1, "2020-01-01")))]
    pages = F.sequence((k % 6).cast("int"), (k % 6 + k % 2).cast("int")), F.sequence((k % 7).cast("int"), (k % 7 + 1).cast("int"))
    flags = op.alignment_flags(*numbers, similarity, *lists)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(flags, ",").alias("flags"), op.token_overlap(*lists).cast("double").alias("overlap"), op.page_distance(*pages).cast("long").alias("distance"))


def neighbor_score(spark: SparkSession, d: str) -> DataFrame:
    """Number scores of the lines before and after, between an order's lines by number and by price."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    by = lambda *c: Window.partitionBy("l_orderkey").orderBy(*c)
    number = lambda c: F.concat((c % 3).cast("string"), F.lit("."), (c % 2).cast("string"))
    a = rows.select("l_orderkey", F.row_number().over(by("l_linenumber")).alias("i"), number(F.col("l_linenumber")).alias("a"))
    b = rows.select("l_orderkey", F.row_number().over(by("price", "l_linenumber")).alias("i"), number(F.col("l_linenumber")).alias("b"))
    pairs = a.join(b, ["l_orderkey", "i"])
    pairs = pairs.withColumn("_s", op.number_score(F.col("a"), F.col("b"), F.lit(0.0)))
    return pairs.select("l_orderkey", "i", op.neighbor_score(F.lag("_s").over(by("i")), F.lead("_s").over(by("i"))).alias("score"))


def position_score(spark: SparkSession, d: str) -> DataFrame:
    """Places of a customer's orders by date and by price."""
    by = lambda c: F.row_number().over(Window.partitionBy("o_custkey").orderBy(c, "o_orderkey")) - 1
    n = F.count("*").over(Window.partitionBy("o_custkey"))
    rows = table(spark, d, "orders").select("o_orderkey", by("o_orderdate").alias("a"), by("o_totalprice").alias("b"), n.alias("n"))
    return rows.select("o_orderkey", F.bround(op.position_score(F.col("a"), F.col("n"), F.col("b"), F.col("n")), 6).alias("score"))


def semantic_gate(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose order lines give fewer than three strong candidates."""
    n = F.col("l_linenumber")
    sources = F.array(F.when(n % 3 == 0, "clause_no").otherwise("position"), F.when(n % 5 == 0, "title_top_k").otherwise("index"))
    return op.semantic_gate(table(spark, d, "lineitem").select("l_partkey", sources.alias("sources")), "l_partkey", "sources")


def exhaustive_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of an order's lines with the next order's, where these are fewer than twenty."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), "l_linenumber", "l_quantity")
    found = op.exhaustive_candidates(rows, rows.withColumn("pair", F.col("pair") - 1), "pair", 20)
    return found.groupBy("pair").agg(F.count("*").alias("n"), F.sum((F.col("l_l_linenumber") * F.col("r_l_linenumber")).cast("long")).alias("places"), F.max(F.abs(F.col("l_l_quantity") - F.col("r_l_quantity"))).alias("widest"))


def page_relationship(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clause pairs, their lines as entries of a page alignment."""
    n = F.col("l_linenumber")
    span = lambda lo, more: F.sequence(lo.cast("int"), (lo + more).cast("int"))
    status = F.when(n % 4 == 0, "UNMATCHED").when(n % 3 == 0, "SPLIT").otherwise("MATCHED")
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), status.alias("status"), span(n, n % 2).alias("original_pages"), span(n + F.col("l_suppkey") % 3, F.lit(0)).alias("compare_pages"), F.col("l_discount").alias("score"))
    k = F.col("o_orderkey")
    pairs = table(spark, d, "orders").select(k.alias("pair"), (k % 5).alias("id"), span(k % 5 + 1, k % 2).alias("original_pages"), span(k % 4 + 1, F.lit(1)).alias("compare_pages"))
    return op.relationship_score(pairs, entries).select("pair", "page_score")


QUERIES = {
    "match_risk_flags": (match_risk_flags, f"""with {_PAIRS}
select k as p_partkey, array_to_string(list_filter([case when f1 then 'SAME_KEY_LOW_BODY_COVERAGE' end, case when f2 then 'CRITICAL_TOKEN_CONFLICT' end, case when f3 then 'SAME_NUMBER_LOW_BODY_SIMILARITY' end, case when f4 then 'BODY_ONLY_ALIGNMENT_RISK' end,
  case when f5 then 'SECTION_PATH_MISMATCH_REVIEW' end], lambda x: x is not null), ',') as flags, method,
  case when f1 or f2 or f3 or f4 or f5 or misaligned or score < 78 or coverage < 0.5 then 'LOW' when coverage < 0.7 then 'MEDIUM' when weak then case when body < 88 then 'LOW' else 'MEDIUM' end
    when k % 10 = 3 then case when body >= 70 then 'MEDIUM' else 'LOW' end when method in ('same_clause_no_low_similarity', 'section_mismatch_blocked') then 'LOW' when body < 65 and title < 75 then 'MEDIUM' else 'NORMAL' end as confidence from m"""),
    "weighted_score": (weighted_score, f"with {_PAIRS} select k as p_partkey, score from s"),
    "candidate_acceptance": (candidate_acceptance, f"""with {_PAIRS},
g as (select *, mismatch and ((key >= 96 and body >= 35) or (path >= 96 and body >= 45) or (same_number and body >= 70) or (same_number and title >= 80 and body >= 55)) as allowed from s)
select k as p_partkey, case when k % 9 = 0 then false when section < 100 and body < 90 and semantic < 88 and not allowed then false when weak and ratio < 70 and (title < 75 or k % 2 = 1) then false when weak and body < 80 and title < 75 then false
  when f1 and body < 55 and title < 80 then false when f3 and title < 80 and score < 78 then false when key >= 96 and body >= 35 then true when same_number then body >= 55 or title >= 80 or score >= 78
  else body >= 85 or (score >= 78 and body >= 55) or (title >= 92 and body >= 55) or (semantic >= 88 and body >= 58) or (partial >= 90 and coverage >= 0.7 and k % 30 >= 20) end as accepted from g"""),
    "body_score_caps": (body_score_caps, """with r as (select p_partkey, p_size * 2.0 as f, p_partkey % 101 as t, p_partkey % 97 as q, p_size as s, p_size + p_partkey % 40 as l from part)
select p_partkey, greatest(f, case when s < 8 then least(t, 70) when s / l < 0.5 then least(t, 76) when s / l < 0.7 then least(t, 86) else t end, case when s < 8 then least(q, 70) when s / l < 0.5 then least(q, 72) when s / l < 0.7 then least(q, 82) when s / l < 0.85 then least(q, 92) else q end)::double as body_score from r"""),
    "clause_number_score": (clause_number_score, """with n as (select p_partkey as k, array_to_string(([p_partkey % 3, p_partkey % 5, p_partkey % 2])[1:p_partkey % 4], '.') as a, array_to_string(([p_partkey % 2, p_partkey % 3, p_partkey % 2])[1:p_partkey % 7 % 4], '.') as b from part),
c as (select *, len(string_split(a, '.')) as x, len(string_split(b, '.')) as y from n)
select k as p_partkey, case when k % 4 = 0 or k % 7 % 4 = 0 then 0 when a = b then 100 when x = y and string_split(a, '.')[-1] = string_split(b, '.')[-1] then 70 when x = y then 40 else k % 41 * 1.25 end::double as score from c"""),
    "section_scores": (section_scores, """with r as (select p_partkey as k, case when p_partkey % 3 = 0 then 'appendix' else 'main_contract' end as ta, case when p_partkey % 5 = 0 then 'appendix' else 'main_contract' end as tb,
  case p_partkey % 4 when 2 then 'I' when 3 then 'I/a' else '' end as pa, case p_partkey % 3 when 2 then 'I' else '' end as pb, p_partkey % 50 * 2.0::double as token from part)
select k as p_partkey, case when ta <> tb then 0 when pa = '' and pb = '' then 100 when pa <> '' and pb <> '' then token else 70 end::double as section, ta = tb and pa <> pb as mismatch,
  case when ta = tb then 0 else greatest(k % 101, case when k % 4 = 0 then 90 else 0 end, case when k % 100 >= 92 and k % 101 >= 80 then 88 else 0 end) end::double as moved,
  case when k % 7 = 0 then 0 when k % 3 = k % 2 then 100 when ta <> tb then 0 else token end::double as key from r"""),
    "alignment_diagnostics": (alignment_diagnostics, f"""with r as (select o_orderkey as k, case when o_orderkey % 4 > 0 then (o_orderkey % 3)::varchar else '' end as a, case when o_orderkey % 5 > 0 then (o_orderkey % 2)::varchar else '' end as b, (o_orderkey % 21) / 20.0::double as s,
  list_filter([case when o_orderkey % 2 = 0 then '30%' end, case when o_orderkey % 3 = 0 then 'USD5' end, case when o_orderkey % 5 = 1 then '2020-01-01' end], lambda x: x is not null) as x,
  list_filter([case when o_orderkey % 2 = 0 then '30%' end, case when o_orderkey % 4 = 1 then 'USD6' end, case when o_orderkey % 5 = 1 then '2020-01-01' end], lambda x: x is not null) as y from orders),
o as (select *, case when len(x) = 0 and len(y) = 0 then 1 when len(x) = 0 or len(y) = 0 then 0 else round_even(len(list_intersect(x, y)) * 1.0::double / len(list_distinct(list_concat(x, y))), 4) end::double as overlap from r),
f as (select *, list_filter([case when a <> '' and b <> '' and a <> b and s >= 0.78 then 'TEXT_MATCH_NUMBER_MISMATCH' end, case when a <> '' and a = b and s < 0.45 then 'TITLE_MATCH_TEXT_MISMATCH' end,
  case when len(x) > 0 and len(y) > 0 and overlap < 0.5 then 'CRITICAL_TOKEN_MISMATCH' end], lambda v: v is not null) as f from o)
select k as o_orderkey, array_to_string(case when len(f) > 0 then list_append(f, '{_MISALIGNED}') else f end, ',') as flags, overlap, greatest(0, k % 6 - (k % 7 + 1), k % 7 - (k % 6 + k % 2))::bigint as distance from f"""),
    "neighbor_score": (neighbor_score, """with r as (select l_orderkey, l_linenumber as n, max(l_extendedprice) as price from lineitem group by 1, 2),
a as (select l_orderkey, row_number() over (partition by l_orderkey order by n) as i, n % 3 as x, n % 2 as y from r), b as (select l_orderkey, row_number() over (partition by l_orderkey order by price, n) as i, n % 3 as x, n % 2 as y from r),
s as (select a.l_orderkey, a.i, case when a.x = b.x and a.y = b.y then 100.0 when a.y = b.y then 70.0 else 40.0 end::double as s from a join b on a.l_orderkey = b.l_orderkey and a.i = b.i),
w as (select l_orderkey, i, lag(s) over (partition by l_orderkey order by i) as p, lead(s) over (partition by l_orderkey order by i) as q from s)
select l_orderkey, i::bigint as i, coalesce((p + q) / 2, p, q, 0)::double as score from w"""),
    "position_score": (position_score, """with r as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as b, greatest(1, count(*) over (partition by o_custkey) - 1) as n from orders)
select o_orderkey, round_even(greatest(0, 100 - 180 * abs((a - 1)::double / n - (b - 1)::double / n)), 6)::double as score from r"""),
    "semantic_gate": (semantic_gate, "select l_partkey, count(*) filter (where l_linenumber % 3 = 0 or l_linenumber % 5 = 0) as strong from lineitem group by 1 having strong < 3"),
    "exhaustive_candidates": (exhaustive_candidates, """with n as (select l_orderkey as k, count(*) as n from lineitem group by 1), p as (select a.k from n a join n b on b.k = a.k + 1 where a.n * b.n < 20)
select k as pair, count(*) as n, sum(a.l_linenumber * b.l_linenumber)::bigint as places, max(abs(a.l_quantity - b.l_quantity)) as widest from p join lineitem a on a.l_orderkey = k join lineitem b on b.l_orderkey = k + 1 group by 1"""),
    "page_relationship": (page_relationship, """with e as (select l_orderkey as k, l_linenumber as o1, l_linenumber + l_linenumber % 2 as o2, l_linenumber + l_suppkey % 3 as c, l_discount as s from lineitem where l_linenumber % 4 <> 0),
p as (select o_orderkey as k, o_orderkey % 5 + 1 as o1, o_orderkey % 5 + 1 + o_orderkey % 2 as o2, o_orderkey % 4 + 1 as c1, o_orderkey % 4 + 2 as c2 from orders)
select p.k as pair, coalesce(max(s), 0)::double as page_score from p left join e on e.k = p.k and e.o1 <= p.o2 and p.o1 <= e.o2 and e.c between p.c1 and p.c2 group by 1"""),
}
