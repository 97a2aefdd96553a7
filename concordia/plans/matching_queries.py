"""Queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import values
from concordia.functions.grams import grams, words
from concordia.operators import lines as ln
from concordia.operators import matching as op
from concordia.plans.line_queries import _LINES
from concordia.sources.tables import table


def clause_no_join(spark: SparkSession, d: str) -> DataFrame:
    """Order lines matched to orders by a clause number of the form order.line."""
    left = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".1")).alias("clause_no"), "o_orderkey")
    right = table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("clause_no"), "l_partkey")
    return left.join(right, "clause_no").select("clause_no", "o_orderkey", "l_partkey")


def clause_key_join(spark: SparkSession, d: str) -> DataFrame:
    key = lambda: F.concat_ws("/", "source", F.lower(F.substring("text", 1, 24))).alias("clause_key")
    docs = table(spark, d, "documents").where("text <> ''")
    sides = docs.groupBy(key()).agg(F.min("doc_id").alias("original_id"), F.max("doc_id").alias("compare_id"), F.count("*").alias("n"))
    return sides.where("n > 1")


def path_join(spark: SparkSession, d: str) -> DataFrame:
    path = lambda brand, kind: F.concat_ws("/", F.lower(brand), F.lower(kind)).alias("path")
    parts = table(spark, d, "part")
    small = parts.where("p_size <= 25").groupBy(path("p_brand", "p_type")).agg(F.count("*").alias("n_small"))
    large = parts.where("p_size > 25").groupBy(path("p_brand", "p_type")).agg(F.count("*").alias("n_large"))
    return small.join(large, "path")


def unique_exact_match(spark: SparkSession, d: str) -> DataFrame:
    lines = ln.line_units(table(spark, d, "documents")).where("line_no > 0")
    even, odd = lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1")
    return op.unique_exact_match(even.select("line", F.col("doc_id").alias("original_id")), odd.select("line", F.col("doc_id").alias("compare_id")), "line", 30)


def full_outer_pairs(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("orders"))
    return op.full_outer_pairs(left, right, "key")


def _ranked(spark: SparkSession, d: str, name: str, key: str, group: str) -> DataFrame:
    """Position of a row in its group, from 0 to 1."""
    window = Window.partitionBy(group)
    rows = table(spark, d, name).select(key, group, F.row_number().over(window.orderBy(key)).alias("index"), F.count("*").over(window).alias("_n"))
    return rows.select(key, group, "index", (F.col("index") / F.col("_n")).alias("position"))


def position_window_join(spark: SparkSession, d: str) -> DataFrame:
    suppliers, customers = _ranked(spark, d, "supplier", "s_suppkey", "s_nationkey"), _ranked(spark, d, "customer", "c_custkey", "c_nationkey")
    same = op.window_join(suppliers.select("s_suppkey", "s_nationkey", "position"), customers.select("c_custkey", "c_nationkey", "position"), "position", 0.15)
    return same.where("s_nationkey = c_nationkey").select("s_suppkey", "c_custkey")


def index_window_join(spark: SparkSession, d: str) -> DataFrame:
    suppliers, customers = _ranked(spark, d, "supplier", "s_suppkey", "s_nationkey"), _ranked(spark, d, "customer", "c_custkey", "c_nationkey")
    return suppliers.join(customers, (F.col("s_nationkey") == F.col("c_nationkey")) & F.abs(suppliers["index"] - customers["index"]).between(0, 3)).select("s_suppkey", "c_custkey")


_POSITIONS = """
s as (select s_suppkey, s_nationkey, row_number() over w as i, row_number() over w * 1.0::double / count(*) over (partition by s_nationkey) as p from supplier window w as (partition by s_nationkey order by s_suppkey)),
c as (select c_custkey, c_nationkey, row_number() over w as i, row_number() over w * 1.0::double / count(*) over (partition by c_nationkey) as p from customer window w as (partition by c_nationkey order by c_custkey))
"""


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents by three recall sources: the first with the same opening, the first with the same closing
    line, and the earlier version most alike in its lines."""
    lines = ln.line_units(table(spark, d, "documents"))
    ends = lines.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("opening"), F.max_by("line", "line_no").alias("closing"))
    first = lambda end: ln.first_with(ends.select("doc_id", F.col(end).alias("line")))
    versions = ln.version_pairs(lines).select(F.col("original_id").alias("left"), F.col("compare_id").alias("right"))
    found = op.candidate_union({"opening": first("opening"), "closing": first("closing"), "lines": versions}, "left", "right")
    return found.select("left", "right", F.array_join("sources", ",").alias("sources"))


CANDIDATES = f"""
with {_LINES},
u as (select distinct doc_id, line from lines), nu as (select doc_id, count(*) as n from u group by 1),
cu as (select a.doc_id as o, b.doc_id as c, count(*) as s from u a join u b on a.line = b.line and a.doc_id < b.doc_id group by 1, 2),
pairs as (select o as original_id, c as compare_id, row_number() over (partition by c order by s::double / (x.n + y.n - s) desc, o) as r from cu join nu x on x.doc_id = o join nu y on y.doc_id = c where 2 * s >= x.n + y.n - s qualify r = 1),
e as (select doc_id, arg_min(line, line_no) as o, arg_max(line, line_no) as c from lines group by 1),
p as (
  select min(doc_id) over (partition by o) as l, doc_id as r, 'opening' as s from e
  union select min(doc_id) over (partition by c), doc_id, 'closing' from e
  union select original_id, compare_id, 'lines' from pairs)
select l as "left", r as "right", string_agg(s, ',' order by s) as sources from p where l < r group by 1, 2
"""


def ngram_containment(spark: SparkSession, d: str) -> DataFrame:
    """Share of a passage's word triples that a document holds, where it holds any three in a row."""

    def triples(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(grams(words(F.lower("text")), 3))).alias("gram"))

    items, docs = triples(table(spark, d, "benchmark"), "item_id"), triples(table(spark, d, "documents"), "doc_id")
    size = items.groupBy("item_id").agg(F.count("*").alias("grams"))
    common = items.join(docs, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("common")).join(size, "item_id")
    return common.select("item_id", "doc_id", F.bround(F.col("common") / F.col("grams"), 6).alias("containment")).where("containment >= 0.2")


CONTAINMENT = r"""
with w as (select 'i' as k, item_id as id, regexp_split_to_array(lower(text), '\s+') as w from benchmark union all select 'd', doc_id, regexp_split_to_array(lower(text), '\s+') from documents),
g as (select distinct k, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from w, range(1, len(w) - 1) r(i) where len(w) >= 3),
n as (select id, count(*) as n from g where k = 'i' group by id),
c as (select a.id as item_id, b.id as doc_id, count(*) as c from g a join g b on a.gram = b.gram and a.k = 'i' and b.k = 'd' group by 1, 2)
select item_id, doc_id, round_even(c * 1.0::double / n, 6) as containment from c join n on n.id = item_id where round_even(c * 1.0::double / n, 6) >= 0.2
"""


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard share of the words of one document and the next in order of id within its source."""
    docs = table(spark, d, "documents")
    # The order is found on ids alone, so a large source moves no texts through one task.
    pairs = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next")).where("next is not null")
    words = docs.select("doc_id", F.array_distinct(F.split(F.trim(F.lower("text")), r"\s+")).alias("words"))
    rows = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("next"), F.col("words").alias("other")), "next").where("other is not null")
    share = F.size(F.array_intersect("words", "other")) / F.size(F.array_union("words", "other"))
    return rows.select("doc_id", F.bround(share, 6).alias("jaccard"))


def business_token_score(spark: SparkSession, d: str) -> DataFrame:
    """Typed tokens of two versions of an order's terms."""
    orders = table(spark, d, "orders")
    price, date = F.format_string("%.2f", "o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    original = F.concat(F.lit("pay $"), price, F.lit(" by "), date, F.lit(" at "), (F.col("o_custkey") % 7).cast("string"), F.lit("%"))
    compare = F.concat(F.lit("pay $"), price, F.lit(" by "), date, F.lit(" at "), (F.col("o_custkey") % 5).cast("string"), F.lit("%"))
    rows = orders.select("o_orderkey", values.token_overlap(values.business_tokens(original), values.business_tokens(compare)).alias("score"))
    return rows.select("o_orderkey", F.bround("score", 2).alias("score"))


def levenshtein_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Names within two edits of one another, of all names."""
    return op.within_edits(table(spark, d, "part"), "p_name", 2)


def fuzzy_topk_ratio(spark: SparkSession, d: str) -> DataFrame:
    """For each passage its five most similar document lines, of all lines."""
    items = [(r.item_id, r.text) for r in table(spark, d, "benchmark").select("item_id", "text").distinct().collect()]
    found = op.best_ratios(ln.line_units(table(spark, d, "documents")), items, 5, 30.0)
    scored = found.select("item_id", "line", F.round("ratio", 4).alias("score"))
    return op.top_k(scored.where("score >= 30"), ["item_id"], [F.col("score").desc(), F.col("line")], 5)


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return op.vector_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 5).select("left", "right", "score", "rank")


_COSINE = """
v as (select label, vec_id, embedding::double[] as e from embeddings),
s as (select a.vec_id as l, b.vec_id as r, round_even(list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)), 6) as s
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id)
"""


def mutual_best(spark: SparkSession, d: str) -> DataFrame:
    return op.mutual_neighbors(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("left", "right", "score")


def greedy_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The even and the odd vectors of a label paired one to one, the best pairs first."""
    return op.assign_vectors(table(spark, d, "embeddings"), "label", "vec_id", "embedding", optimal=False).withColumnRenamed("block", "pair")


def optimal_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The even and the odd vectors of a label paired one to one, by the highest total."""
    found = op.assign_vectors(table(spark, d, "embeddings"), "label", "vec_id", "embedding", optimal=True)
    return found.withColumnRenamed("block", "pair").withColumn("score", F.col("score") * 100)


def mask_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Order lines that no mask of their part covers by half."""
    boxes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 10).alias("hi"))
    masks = table(spark, d, "part").where("p_size <= 20").select("p_partkey", F.col("p_size").cast("double").alias("m_lo"), (F.col("p_size") + 15.0).alias("m_hi"))
    covered = (F.least("hi", "m_hi") - F.greatest("lo", "m_lo")) >= 0.5 * (F.col("hi") - F.col("lo"))
    return boxes.join(masks, (F.col("l_partkey") == F.col("p_partkey")) & covered, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "lo")


def contained_span(spark: SparkSession, d: str) -> DataFrame:
    """Where a passage stands whole in a document: its first five words pick the candidates."""
    tokens = F.split("text", " ")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), F.array_join(F.slice(tokens, 2, 5), " ").alias("_k"))
    docs = table(spark, d, "documents")
    keyed = docs.select("doc_id", F.explode(F.array_distinct(grams(tokens, 5))).alias("_k"))
    pairs = items.join(keyed, "_k").select("item_id", "passage", "doc_id").distinct().join(docs.select("doc_id", "text"), "doc_id")
    return pairs.select("item_id", "doc_id", F.expr("locate(passage, text)").cast("long").alias("at")).where("at > 0")


def adjacent_scope_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = op.adjacent_scopes(table(spark, d, "conversations"), ["conv_id"], "turn", "text", 3)
    return rows.select("conv_id", "turn", "size", F.length("scope").cast("long").alias("n"), F.md5("scope").alias("scope"))


def page_sequence_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Conversations against the next one, turns as pages."""
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    left, right = turns.withColumn("pair", F.col("conv_id")), turns.withColumn("pair", F.col("conv_id") - 1).where("pair >= 0")
    return op.per_pair(left, right, "pair", "page", "text", op.aligned_pages, "status string, original_pages array<int>, compare_pages array<int>, score double")


def row_lcs_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an order's table against the next order's, by text."""
    row = F.concat_ws(" ", F.col("l_quantity").cast("int"), "l_returnflag", "l_linestatus", F.col("l_suppkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row"))
    left, right = rows.withColumn("pair", F.col("l_orderkey")), rows.withColumn("pair", F.col("l_orderkey") - 1)
    return op.per_pair(left, right, "pair", "l_linenumber", "row", op.lcs_rows, "original_row int, compare_row int, score double")


def positional_zip_join(spark: SparkSession, d: str) -> DataFrame:
    """Returned and kept lines of a supplier and part paired by position, the surplus one-sided."""
    place = F.row_number().over(Window.partitionBy("l_partkey", "l_suppkey", "l_linestatus").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))
    rows = table(spark, d, "lineitem").withColumn("place", place)
    side = lambda flag, name: rows.where(F.col("l_linestatus") == flag).select("l_partkey", "l_suppkey", "place", F.col("l_orderkey").alias(name))
    return side("F", "original_order").join(side("O", "compare_order"), ["l_partkey", "l_suppkey", "place"], "full_outer")


QUERIES = {
    "clause_no_join": (clause_no_join, "select o_orderkey || '.1' as clause_no, o_orderkey, l_partkey from orders join lineitem on o_orderkey || '.1' = l_orderkey || '.' || l_linenumber"),
    "clause_key_join": (clause_key_join, "select source || '/' || lower(text[1:24]) as clause_key, min(doc_id) as original_id, max(doc_id) as compare_id, count(*) as n from documents where text <> '' group by 1 having count(*) > 1"),
    "path_join": (path_join, """with s as (select lower(p_brand) || '/' || lower(p_type) as path, count(*) as n_small from part where p_size <= 25 group by 1),
l as (select lower(p_brand) || '/' || lower(p_type) as path, count(*) as n_large from part where p_size > 25 group by 1) select s.path, n_small, n_large from s join l on s.path = l.path"""),
    "unique_exact_match": (unique_exact_match, f"""with {_LINES},
e as (select line, min(doc_id) as original_id from lines where line_no > 0 and doc_id % 2 = 0 and length(line) >= 30 group by line having count(*) = 1),
o as (select line, min(doc_id) as compare_id from lines where line_no > 0 and doc_id % 2 = 1 and length(line) >= 30 group by line having count(*) = 1)
select e.line, original_id, compare_id from e join o on e.line = o.line"""),
    "full_outer_pairs": (full_outer_pairs, """with r as (select o_custkey as key, count(*) as orders from orders group by 1)
select coalesce(c_custkey, key) as key, c_mktsegment, orders, case when key is null then 'DELETE' when c_custkey is null then 'ADD' else 'MATCH' end as status from customer full join r on c_custkey = key"""),
    "position_window_join": (position_window_join, f"with {_POSITIONS} select s_suppkey, c_custkey from s join c on s_nationkey = c_nationkey and abs(s.p - c.p) <= 0.15::double"),
    "index_window_join": (index_window_join, f"with {_POSITIONS} select s_suppkey, c_custkey from s join c on s_nationkey = c_nationkey and abs(s.i - c.i) <= 3"),
    "candidate_union": (candidate_union, CANDIDATES),
    "ngram_containment": (ngram_containment, CONTAINMENT),
    "token_jaccard": (token_jaccard, r"""with w as (select doc_id, source, list_distinct(regexp_split_to_array(trim(lower(text)), '\s+')) as w from documents),
p as (select doc_id, w, lead(w) over (partition by source order by doc_id) as o from w)
select doc_id, round_even(len(list_intersect(w, o)) * 1.0::double / len(list_distinct(list_concat(w, o))), 6) as jaccard from p where o is not null"""),
    "business_token_score": (business_token_score, """select o_orderkey, case when o_custkey % 7 = o_custkey % 5 then 100.0 else 50.0 end::double as score from orders"""),
    "levenshtein_prefilter": (levenshtein_prefilter, """with n as (select distinct p_name from part)
select x.p_name as a, y.p_name as b, levenshtein(x.p_name, y.p_name)::bigint as distance from n x join n y on x.p_name < y.p_name and abs(length(x.p_name) - length(y.p_name)) <= 2 where levenshtein(x.p_name, y.p_name) <= 2"""),
    "fuzzy_topk_ratio": (fuzzy_topk_ratio, None),
    "vector_topk_cosine": (vector_topk_cosine, f"""with {_COSINE}, r as (select l, r, s, row_number() over (partition by l order by s desc, r) as k from s) select l as "left", r as "right", s as score, k as rank from r where k <= 5"""),
    "mutual_best": (mutual_best, f"""with {_COSINE}, r as (select l, r, s, row_number() over (partition by l order by s desc, r) as x, row_number() over (partition by r order by s desc, l) as y from s)
select l as "left", r as "right", s as score from r where x = 1 and y = 1"""),
    "greedy_assignment": (greedy_assignment, None),
    "optimal_assignment": (optimal_assignment, None),
    "mask_anti_join": (mask_anti_join, """select l_orderkey, l_linenumber, l_partkey, l_quantity as lo from lineitem where not exists (select 1 from part where p_size <= 20 and p_partkey = l_partkey
  and least(l_quantity + 10, p_size + 15.0) - greatest(l_quantity, p_size) >= 5)"""),
    "contained_span": (contained_span, "select item_id, doc_id, strpos(d.text, b.text)::bigint as at from benchmark b join documents d on contains(d.text, b.text)"),
    "adjacent_scope_concat": (adjacent_scope_concat, """with s as (
  select conv_id, turn, 1 as size, text as t from conversations
  union all select conv_id, turn, 2, text || lead(text) over w from conversations window w as (partition by conv_id order by turn)
  union all select conv_id, turn, 3, text || lead(text) over w || lead(text, 2) over w from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, size::bigint as size, length(t)::bigint as n, md5(t) as scope from s where t is not null"""),
    "page_sequence_alignment": (page_sequence_alignment, None),
    "row_lcs_alignment": (row_lcs_alignment, None),
    "positional_zip_join": (positional_zip_join, """with r as (select *, row_number() over (partition by l_partkey, l_suppkey, l_linestatus order by l_orderkey, l_linenumber, l_quantity, l_extendedprice) as place from lineitem),
f as (select * from r where l_linestatus = 'F'), o as (select * from r where l_linestatus = 'O')
select coalesce(f.l_partkey, o.l_partkey) as l_partkey, coalesce(f.l_suppkey, o.l_suppkey) as l_suppkey, coalesce(f.place, o.place) as place, f.l_orderkey as original_order, o.l_orderkey as compare_order
from f full join o on f.l_partkey = o.l_partkey and f.l_suppkey = o.l_suppkey and f.place = o.place"""),
}
