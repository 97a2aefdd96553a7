"""Queries of typed values, JSON, cells, decisions and task logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import values
from concordia.functions.diff import changed_ranges
from concordia.operators import cells as ce
from concordia.operators import lifecycle as lc
from concordia.operators import lines as ln
from concordia.sources.tables import shared_folder, table
from concordia.streaming.progress import latest_progress, run_available


def canonical_amount(spark: SparkSession, d: str) -> DataFrame:
    """Prices written with a sign, thousands and a unit, read back."""
    shown = F.concat(F.element_at(F.array(F.lit("¥"), F.lit("人民币"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.format_number("o_totalprice", 2), F.when(F.col("o_custkey") % 2 == 0, " 元").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", values.canonical_amount(shown).alias("amount"))


def canonical_date(spark: SparkSession, d: str) -> DataFrame:
    form = lambda pattern: F.date_format("o_orderdate", pattern)
    shown = F.when(F.col("o_orderkey") % 3 == 0, form("yyyy年M月d日")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("on "), form("yyyy/M/d"))).otherwise(form("yyyy.MM.dd"))
    return table(spark, d, "orders").select("o_orderkey", values.canonical_date(shown).alias("date"))


def canonical_percent(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.format_string("%.1f", F.col("l_discount") * 100), F.when(F.col("l_orderkey") % 2 == 0, " %").otherwise("％"))
    return table(spark, d, "lineitem").groupBy(values.canonical_percent(shown).alias("percent")).agg(F.count("*").alias("n"))


def typed_cells(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_orderkey") % 4
    shown = F.when(kind == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(kind == 1, F.concat(F.col("l_quantity").cast("int"), F.lit("台"))).when(kind == 2, F.format_string("%.2f", "l_extendedprice")).otherwise(F.lit("as agreed"))
    found = values.typed_cell(shown)
    return table(spark, d, "lineitem").groupBy(F.substring_index(found, ":", 1).alias("type"), found.alias("value")).agg(F.count("*").alias("n"))


def json_summary_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("band"), (F.instr("props", "k") > 0).alias("has_k"))


def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", lc.identity("E-", F.col("n_name"), F.col("n_regionkey")).alias("identity"))


def char_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of characters between blanks, with where they begin and end."""
    chars = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("at", "char")).where("char <> ' '")
    return ln.islands(chars, ["item_id"], F.col("at"), 1)


def html_tag_scan(spark: SparkSession, d: str) -> DataFrame:
    return ce.html_tags(table(spark, d, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.min("at").cast("long").alias("first"))


def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    """Cells of an order's table against a version with some prices changed, dropped and added."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    shown = F.format_string("%.2f", "price")
    original = lines.where("l_orderkey % 11 <> 0").select("l_orderkey", "l_linenumber", shown.alias("value"))
    changed = F.when(F.col("l_orderkey") % 7 == 0, F.format_string("%.2f", F.col("price") + 1)).otherwise(F.format_number("price", 2))
    compare = lines.where("l_orderkey % 13 <> 0").select("l_orderkey", "l_linenumber", changed.alias("value"))
    found = ce.cell_changes(original, compare, ["l_orderkey", "l_linenumber"], "value", values.typed_cell(F.col("value")))
    return found.withColumn("after", F.regexp_replace("after", ",", ""))


def table_type(spark: SparkSession, d: str) -> DataFrame:
    """Tables that hold two header cells out of all types, by part."""
    heads = F.array(*[F.lit(x) for x in ("备注", "产品名称", "付款节点", "测试指标", "通讯地址", "签订日期", "数量")])
    cell = lambda i: F.element_at(heads, (i % 7 + 1).cast("int"))
    text = F.concat(cell(F.col("p_partkey")), F.lit(" \n"), cell(F.floor(F.col("p_partkey") / 7)), F.lit(" 1"))
    return table(spark, d, "part").select("p_partkey", ce.table_type(text).alias("type"))


def observation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """States derived from order lines; every combination occurs."""
    state = lambda c: F.element_at(F.array(F.lit("OBSERVED_VALUE"), F.lit("OBSERVED_BLANK"), F.lit("UNOBSERVED")), (c % 3 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(state(F.col("l_partkey")).alias("original_state"), state(F.col("l_suppkey")).alias("compare_state"), (F.col("l_linenumber") % 2 == 0).alias("values_equal"), (F.col("l_orderkey") % 2 == 0).alias("content_reliable"), (F.col("l_orderkey") % 5 == 0).alias("removed"))
    found = lc.observation_decision(rows)
    return found.groupBy("original_state", "compare_state", "decision", "reason", "fill_change").agg(F.count("*").alias("n"))


def ocr_routing_case(spark: SparkSession, d: str) -> DataFrame:
    n, odd = F.length("text"), F.length(F.regexp_replace("text", "[ -~\n]", ""))
    route = ln.first_reason(("SCANNED", n < 30), ("SUSPICIOUS", odd / n > 0.08), ("FORM", F.length(F.regexp_replace("text", "[^|]", "")) >= 5), ("MIXED", n < 400), default="NATIVE_GOOD")
    return table(spark, d, "documents").select("doc_id", route.alias("route"))


def suppression_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first reason that suppresses an event; protected ones survive all but the direct reasons."""
    reason = F.coalesce(F.when(F.col("value").isNull(), "MISSING"), F.when((F.col("value") < 2) & (F.col("event_type") != "purchase"), "TINY"), F.when(F.col("event_type") == "view", "VIEW_ONLY"), F.when(F.col("user_id") % 10 == 0, "INTERNAL"))
    protected = (F.col("event_type") == "purchase") & (F.coalesce(reason, F.lit("")) != "MISSING")
    return table(spark, d, "events").select("event_id", F.when(protected, None).otherwise(reason).alias("reason"))


def access_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("owner"))
    return lc.readable(rows, "owner", "", True)


def task_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return lc.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def task_upsert(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    state = lc.latest(events.where("event_id % 2 = 0 and user_id % 3 <> 0"), "user_id", "event_id").withColumn("revision", F.lit(1))
    changes = lc.latest(events.where("event_id % 2 = 1 and user_id % 4 <> 0"), "user_id", "event_id").withColumn("revision", F.lit(1))
    return lc.upsert(state, changes, "user_id", ["event_id"])


def transition_guard(spark: SparkSession, d: str) -> DataFrame:
    name = {"P": "PROCESSING", "F": "FAILED", "O": "COMPLETED"}
    known = F.create_map(*[F.lit(x) for kv in name.items() for x in kv])
    orders = table(spark, d, "orders")
    later = F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moves = orders.select("o_orderkey", known[F.col("o_orderstatus")].alias("status"), known[later].alias("target")).where("target is not null")
    return lc.allowed(moves).select("o_orderkey", "status", "target")


def bulk_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderstatus") == "P", "SERVICE_RESTARTED").alias("reason")).agg(F.count("*").alias("n"))


def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").where(day.between(F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1996-06-30")))).select("o_orderkey", "o_custkey")


def audit_fanout(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_compact(F.array(F.when(F.col("value") > 60, "ADD"), F.when(F.col("value") < 30, "DELETE"), F.when(F.col("event_type") == "click", "MODIFY")))
    items = F.when(F.size(parts) == 0, F.array(F.lit("FALLBACK"))).otherwise(parts)
    return table(spark, d, "events").select("event_id", F.explode(items).alias("item"))


def review_carry_over(spark: SparkSession, d: str) -> DataFrame:
    reviews = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "CONFIRMED").otherwise("IGNORED").alias("_state"))
    return table(spark, d, "documents").join(reviews, "doc_id", "left").select("doc_id", F.coalesce("_state", F.lit("PENDING")).alias("review"))


def range_merge(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping or touching ranges of a supplier become one; mixed types become MODIFY."""
    lines = table(spark, d, "lineitem")
    rows = lines.select("l_suppkey", (F.col("l_partkey") * 10).alias("lo"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("int") * 5).alias("hi"), F.when(F.col("l_returnflag") == "N", "ADD").otherwise("DELETE").alias("type"))
    merged = ce.interval_clusters(rows, ["l_suppkey"], "lo", "hi", 0, "cluster")
    kinds = F.count_distinct("type")
    return merged.groupBy("l_suppkey", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.when(kinds > 1, "MODIFY").otherwise(F.min("type")).alias("type")).drop("cluster")


def position_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ce.position_label(F.col("p_size"), F.col("p_partkey") % 100).alias("label"))


def text_diff_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Changed ranges of the lines of version pairs: line by line at equal places."""
    lines = ln.line_units(table(spark, d, "documents"))
    pairs = ln.version_pairs(lines).select("original_id", "compare_id")
    a = lines.select(F.col("doc_id").alias("original_id"), "line_no", F.col("line").alias("before"))
    b = lines.select(F.col("doc_id").alias("compare_id"), "line_no", F.col("line").alias("after"))
    rows = pairs.join(a, "original_id").join(b, ["compare_id", "line_no"]).where("before <> after")

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = [(r.original_id, r.compare_id, r.line_no, *x) for r in frame.itertuples(index=False) for x in changed_ranges(r.before, r.after)]
            yield pd.DataFrame(out, columns=["original_id", "compare_id", "line_no", "type", "a_start", "a_end", "b_start", "b_end"])

    return rows.select("original_id", "compare_id", "line_no", "before", "after").mapInPandas(run, "original_id long, compare_id long, line_no long, type string, a_start long, a_end long, b_start long, b_end long")


def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_progress(table(spark, d, "events"), "user_id", "event_id", "event_type", ["purchase"])


def stream_progress_latest(spark: SparkSession, d: str) -> DataFrame:
    """The same states, from the event table read as a stream."""
    schema = table(spark, d, "events").schema
    base = f"{shared_folder(spark)}/concordia/progress-{uuid.uuid4().hex}"
    return run_available(spark, d, schema, "user_id", "event_id", "event_type", f"{base}/out", f"{base}/state", "events.parquet", ["purchase"])


_PROGRESS = """with t as (select user_id, min(event_id) filter (where event_type = 'purchase') as t, max(event_id) as m, max(least(value, 99.0)) filter (where event_type <> 'purchase') as p from events group by 1)
select t.user_id, event_id, event_type, case when event_type = 'purchase' then 100.0 else coalesce(p, 0.0) end::double as progress from t join events on events.event_id = coalesce(t.t, t.m)"""

QUERIES = {
    "canonical_amount": (canonical_amount, "select o_orderkey, round_even(o_totalprice, 2)::decimal(30,2)::varchar as amount from orders"),
    "canonical_date": (canonical_date, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date from orders"),
    "canonical_percent": (canonical_percent, "select round(l_discount * 100, 1)::decimal(30,4)::varchar as percent, count(*) as n from lineitem group by 1"),
    "typed_cells": (typed_cells, """with v as (select case l_orderkey % 4 when 0 then 'date:' || strftime(l_shipdate, '%Y-%m-%d') when 1 then 'quantity:' || l_quantity::int || '.0000台' when 2 then 'amount:' || l_extendedprice::decimal(30,2) else 'as agreed' end as value from lineitem)
select split_part(value, ':', 1) as type, value, count(*) as n from v group by 1, 2"""),
    "json_summary_projection": (json_summary_projection, "select event_id, (props::json->>'k')::bigint as k, case when (props::json->>'k')::bigint >= 50 then 'high' else 'low' end as band, contains(props, 'k') as has_k from events"),
    "identity_hash": (identity_hash, """select n_nationkey, 'E-' || sha256('{"k0":"' || n_name || '","k1":' || n_regionkey || '}')[1:24] as identity from nation"""),
    "char_runs": (char_runs, """with c as (select item_id, i - 1 as p from benchmark, range(1, length(text) + 1) r(i) where text[i:i] <> ' '), g as (select *, p - row_number() over (partition by item_id order by p) as g from c)
select item_id, min(p)::bigint as first, max(p)::bigint as last, count(*) as n from g group by item_id, g"""),
    "html_tag_scan": (html_tag_scan, """with t as (select page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1) as t from pages), u as (select page_id, i - 1 as p, lower(t[i]) as tag from t, range(1, len(t) + 1) r(i))
select page_id, tag, count(*) as n, min(p)::bigint as first from u group by 1, 2"""),
    "cell_diff": (cell_diff, """with l as (select l_orderkey, l_linenumber, max(l_extendedprice) as price from lineitem group by 1, 2),
o as (select l_orderkey, l_linenumber, price::decimal(30,2) as v from l where l_orderkey % 11 <> 0),
c as (select l_orderkey, l_linenumber, (case when l_orderkey % 7 = 0 then price + 1 else price end)::decimal(30,2) as v from l where l_orderkey % 13 <> 0)
select coalesce(o.l_orderkey, c.l_orderkey) as l_orderkey, coalesce(o.l_linenumber, c.l_linenumber) as l_linenumber, case when c.v is null then 'DELETE' when o.v is null then 'ADD' else 'MODIFY' end as status,
  o.v::varchar as before, c.v::varchar as after
from o full join c on o.l_orderkey = c.l_orderkey and o.l_linenumber = c.l_linenumber where o.v is distinct from c.v"""),
    "table_type": (table_type, """with r as (select p_partkey, p_partkey % 7 as a, p_partkey // 7 % 7 as b from part)
select p_partkey, case when 1 in (a, b) then 'product' when 2 in (a, b) then 'payment' when 3 in (a, b) then 'acceptance' when 4 in (a, b) then 'contact' when 5 in (a, b) then 'cover' else 'generic' end as type from r"""),
    "observation_matrix": (observation_matrix, """with r as (select case l_partkey % 3 when 0 then 'OBSERVED_VALUE' when 1 then 'OBSERVED_BLANK' else 'UNOBSERVED' end as o, case l_suppkey % 3 when 0 then 'OBSERVED_VALUE' when 1 then 'OBSERVED_BLANK' else 'UNOBSERVED' end as c,
  l_linenumber % 2 = 0 as e, l_orderkey % 2 = 0 as rel, l_orderkey % 5 = 0 as rem from lineitem),
x as (select o, c, case
  when o = 'OBSERVED_VALUE' and c = 'UNOBSERVED' and rem and rel then 'CONFIRMED|BUSINESS_CONTENT_REMOVED_OR_COVERED|cleared'
  when o = 'UNOBSERVED' and c = 'UNOBSERVED' then 'NEEDS_REVIEW|BOTH_SIDES_UNOBSERVED|' when o = 'UNOBSERVED' then 'NEEDS_REVIEW|ORIGINAL_UNOBSERVED|' when c = 'UNOBSERVED' then 'NEEDS_REVIEW|COMPARE_UNOBSERVED|'
  when o = 'OBSERVED_BLANK' and c = 'OBSERVED_VALUE' then 'CONFIRMED|OBSERVED_BLANK_TO_VALUE|filled' when o = 'OBSERVED_VALUE' and c = 'OBSERVED_BLANK' then 'CONFIRMED|OBSERVED_VALUE_TO_BLANK|cleared'
  when o = 'OBSERVED_BLANK' then 'CONFIRMED|BOTH_SIDES_OBSERVED_BLANK|' when e then 'CONFIRMED|OBSERVED_VALUES_EQUAL|' when rel then 'CONFIRMED|OBSERVED_VALUES_DIFFER|' else 'NEEDS_REVIEW|OBSERVED_VALUE_CONTENT_UNCERTAIN|' end as d from r)
select o as original_state, c as compare_state, split_part(d, '|', 1) as decision, split_part(d, '|', 2) as reason, split_part(d, '|', 3) as fill_change, count(*) as n from x group by 1, 2, 3, 4, 5"""),
    "ocr_routing_case": (ocr_routing_case, r"""select doc_id, case when length(text) < 30 then 'SCANNED' when length(regexp_replace(text, '[ -~\n]', '', 'g')) * 1.0 / length(text) > 0.08 then 'SUSPICIOUS'
  when length(regexp_replace(text, '[^|]', '', 'g')) >= 5 then 'FORM' when length(text) < 400 then 'MIXED' else 'NATIVE_GOOD' end as route from documents"""),
    "suppression_ladder": (suppression_ladder, """select event_id, case when value is null then 'MISSING' when event_type = 'purchase' then null when value < 2 then 'TINY' when event_type = 'view' then 'VIEW_ONLY' when user_id % 10 = 0 then 'INTERNAL' end as reason from events"""),
    "access_filter": (access_filter, "select o_orderkey, c_name as owner from orders join customer on o_custkey = c_custkey where c_acctbal >= 0"),
    "task_latest_state": (task_latest_state, "select user_id, event_id, event_type, value from events where event_id in (select max(event_id) from events group by user_id)"),
    "task_upsert": (task_upsert, """with s as (select * from events where event_id in (select max(event_id) from events where event_id % 2 = 0 and user_id % 3 <> 0 group by user_id)), c as (select * from events where event_id in (select max(event_id) from events where event_id % 2 = 1 and user_id % 4 <> 0 group by user_id))
select coalesce(c.user_id, s.user_id) as user_id, coalesce(s.event_id, c.event_id) as event_id, coalesce(c.event_type, s.event_type) as event_type, case when c.user_id is null then s.value else c.value end as value, case when s.user_id is not null and c.user_id is not null then 2 else 1 end as revision
from s full join c on s.user_id = c.user_id"""),
    "transition_guard": (transition_guard, """with n as (select o_orderkey, case o_orderstatus when 'P' then 'PROCESSING' when 'F' then 'FAILED' else 'COMPLETED' end as s, o_custkey from orders), m as (select o_orderkey, s as status, lead(s) over (partition by o_custkey order by o_orderkey) as target from n)
select * from m where (status = 'PROCESSING' and target is not null) or (status = 'FAILED' and target = 'PROCESSING')"""),
    "bulk_repair": (bulk_repair, "select case when o_orderstatus = 'P' then 'F' else o_orderstatus end as status, case when o_orderstatus = 'P' then 'SERVICE_RESTARTED' end as reason, count(*) as n from orders group by 1, 2"),
    "date_range_filter": (date_range_filter, "select o_orderkey, o_custkey from orders where o_orderdate::date between date '1996-01-01' and date '1996-06-30'"),
    "audit_fanout": (audit_fanout, """with p as (select event_id, list_filter([case when value > 60 then 'ADD' end, case when value < 30 then 'DELETE' end, case when event_type = 'click' then 'MODIFY' end], lambda x: x is not null) as p from events)
select event_id, unnest(case when len(p) = 0 then ['FALLBACK'] else p end) as item from p"""),
    "review_carry_over": (review_carry_over, "select documents.doc_id, case when quality = 1 then 'CONFIRMED' when labels.doc_id is not null then 'IGNORED' else 'PENDING' end as review from documents left join labels on documents.doc_id = labels.doc_id"),
    "range_merge": (range_merge, """with r as (select l_suppkey, l_partkey * 10 as lo, l_partkey * 10 + l_quantity::int * 5 as hi, case when l_returnflag = 'N' then 'ADD' else 'DELETE' end as t from lineitem),
n as (select *, case when lo <= max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from r),
g as (select *, sum(new) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as g from n)
select l_suppkey, min(lo) as lo, max(hi) as hi, case when count(distinct t) > 1 then 'MODIFY' else min(t) end as type from g group by l_suppkey, g"""),
    "position_labels": (position_labels, "select p_partkey, case when p_partkey % 100 < 26 then chr((65 + p_partkey % 100)::int) else chr((64 + p_partkey % 100 // 26)::int) || chr((65 + p_partkey % 100 % 26)::int) end || (p_size + 1) as label from part"),
    "text_diff_ranges": (text_diff_ranges, None),
    "progress_latest": (progress_latest, _PROGRESS),
    "stream_progress_latest": (stream_progress_latest, _PROGRESS),
}
