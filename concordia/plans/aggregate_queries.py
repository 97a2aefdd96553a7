"""Queries of aggregation, windows, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.operators import aggregates as op
from concordia.operators.lines import islands
from concordia.plans.line_queries import _LINES, _lines
from concordia.sources.tables import ordered_table, table

_STATUS = {"click": "MODIFY", "view": "MATCH", "error": "DELETE", "signup": "ADD", "purchase": "INSERT"}


def event_change_counts(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])
    return op.count_changes(table(spark, d, "events").withColumn("status", known[F.col("event_type")]), ["user_id"])


def audit_stats(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.groupBy("event_type").agg(F.count_if(F.expr("value >= 50")).alias("confirmed"), F.count_if(F.expr("value < 50")).alias("needs_review"), F.count("*").alias("total"))


def quality_summary_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.length("text") < 200, "short"), F.when(F.col("quality").isNull(), "unlabelled")))
    return docs.select("source", F.explode(flags).alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))


def page_quality_status(spark: SparkSession, d: str) -> DataFrame:
    """An order as a page, its lines as blocks: risk categories give a status and a score."""
    lines = ordered_table(spark, d, "lineitem", "l_orderkey", "l_discount", "l_quantity", "l_tax")
    rows = op.ordered_means(lines, ["l_orderkey"], ["_file", "_row"], {"_a": "l_discount", "_q": "l_quantity"}, (F.count_if(F.expr("l_tax > 0.06")) / F.count("*")).alias("_low"))
    low, layout, thin = F.col("_low") > 0.20, F.col("_a") < 0.03, F.col("_q") < 15
    risks = low.cast("int") + layout.cast("int") + thin.cast("int")
    status = F.when(risks >= 2, "UNRELIABLE").when(low, "LOW_TEXT").when(layout, "LAYOUT").when(thin, "THIN").otherwise("OK")
    return rows.select("l_orderkey", status.alias("status"), F.bround(1 - 0.2 * risks, 4).cast("double").alias("score"))


def page_quality_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The worst status of a customer's pages by priority, and pages by status."""
    pages = page_quality_status(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in {"UNRELIABLE": 4, "LOW_TEXT": 3, "LAYOUT": 2, "THIN": 1, "OK": 0}.items() for x in kv]), F.col("status"))
    return pages.groupBy("o_custkey").agg(F.max_by("status", priority).alias("status"), F.count_if(F.expr("status <> 'OK'")).alias("risk_pages"), F.count("*").alias("pages"))


def document_profile_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("long").alias("level"))


def clause_split_quality(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    n = F.length("line")
    per_line = lines.groupBy("doc_id", "line").agg(F.count("*").alias("_times"))
    repeated = per_line.groupBy("doc_id").agg(F.count_if(F.expr("_times > 1")).alias("duplicate_lines"))
    stats = lines.groupBy("doc_id").agg(F.count_if(n < 8).alias("short"), F.count_if(n > 1500).alias("long"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.bround(F.avg(n), 4).alias("mean"))
    return stats.join(repeated, "doc_id")


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def cross_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of documents with one text, the winner by source priority; all sources are remembered."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.lower(F.trim("text"))).alias("folded"))
    rows = op.winner(docs, ["folded"], [F.col("source"), F.col("doc_id")], {"merged": "source"})
    return rows.select("doc_id", "source", F.array_join("merged", ",").alias("merged_sources"))


def informative_scalar_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(*op.informative("c_mktsegment"))


def spatial_overlap_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Boxes derived from parts on the page of their brand; pairs that cover one another by 0.8."""
    x, y = F.col("p_partkey") % 97, F.col("p_size") * 2
    boxes = table(spark, d, "part").select("p_brand", "p_partkey", x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 12.0).alias("x1"), (y + 6.0 + F.col("p_partkey") % 3).alias("y1"))
    return op.overlap_pairs(boxes, ["p_brand"], "p_partkey", 0.8, 20.0)


def column_event_aggregation(spark: SparkSession, d: str) -> DataFrame:
    """Cell events that cover every row of a column become one column event."""
    lines = table(spark, d, "lineitem")
    rows = lines.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("rows"))
    columns = F.array(F.when(F.col("l_discount") > 0.02, "discount"), F.when(F.col("l_tax") > 0.01, "tax"), F.when(F.col("l_quantity") > 10, "quantity"))
    cells = lines.select("l_orderkey", "l_linenumber", F.explode(F.array_compact(columns)).alias("column"))
    events = cells.groupBy("l_orderkey", "column").agg(F.size(F.collect_set("l_linenumber")).cast("long").alias("covered"))
    return events.join(rows, "l_orderkey").where("covered >= 2 and covered = rows").select("l_orderkey", "column", "covered")


def watermark_families(spark: SparkSession, d: str) -> DataFrame:
    """Counts of folded short lines with the representative spelling, the most frequent, then the longest."""
    short = _lines(spark, d).where("length(line) <= 40").groupBy(F.regexp_replace(F.lower("line"), "[ .,|]", "").alias("family"), "line").agg(F.count("*").alias("n"))
    return short.groupBy("family").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.length("line"), "line"))["line"].alias("representative"))


def observation_aggregation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source")
    unseen, value = F.bool_or(F.col("quality").isNull()), F.bool_or(F.col("quality") == 1)
    return rows.agg(F.when(unseen, "UNOBSERVED").when(value, "OBSERVED_VALUE").otherwise("OBSERVED_BLANK").alias("state"))


def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("count"), F.bround(F.sum(F.col("value").cast("decimal(20,4)")), 4).cast("double").alias("total"), F.max("value").alias("max"))


def contiguous_event_groups(spark: SparkSession, d: str) -> DataFrame:
    """Successive events of a user of one type, broken by any other."""
    window = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("_new", (F.lag("event_type").over(window) != F.col("event_type")).cast("int"))
    rows = rows.withColumn("_group", F.sum(F.coalesce("_new", F.lit(0))).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "event_type", "_group").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n")).drop("_group")


def page_number_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Whether an order's key lies within 2000 of the order before or after it by date."""
    window = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").withColumn("page", F.row_number().over(window))
    ahead = lambda f: F.coalesce(F.abs(f("o_orderkey").over(window) - F.col("o_orderkey")) < 2000, F.lit(False))
    return rows.select("o_orderkey", "page", (ahead(F.lag) | ahead(F.lead)).alias("valid"))


def monotone_progress(spark: SparkSession, d: str) -> DataFrame:
    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").select("event_id", F.least(F.lit(99.0), F.max("value").over(window)).alias("progress"))


def reading_order_conflicts(spark: SparkSession, d: str) -> DataFrame:
    window = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("_before", F.lag("l_shipdate").over(window))
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("_before") > F.col("l_shipdate")).alias("conflicts"))


def dominant_position(spark: SparkSession, d: str) -> DataFrame:
    """Rows near the median size of their brand."""
    rows = table(spark, d, "part").withColumn("_mid", F.percentile("p_size", 0.5).over(Window.partitionBy("p_brand")))
    return rows.where(F.abs(F.col("p_size") - F.col("_mid")) <= 4).select("p_partkey", "p_brand")


def median_centre(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.median("p_size").alias("mid_size"), F.bround(F.median("p_retailprice"), 4).alias("mid_price"))


def records_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of ten finished records, the latest first."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return rows.offset(20).limit(10).select("o_orderkey", "o_custkey", "o_totalprice")


def records_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"), F.ceil(F.count("*") / 10).cast("long").alias("pages"))


def candidate_top5(spark: SparkSession, d: str) -> DataFrame:
    window = Window.partitionBy("l_partkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(window)).where("rank <= 5")
    return rows.select("l_partkey", "rank", "l_orderkey", "l_extendedprice")


def flat_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Lines of even documents that odd ones don't cancel, and the other way round, with their side."""
    lines = _lines(spark, d)
    even, odd = lines.where("doc_id % 2 = 0").select("line"), lines.where("doc_id % 2 = 1").select("line")
    both = even.exceptAll(odd).withColumn("side", F.lit("original")).unionByName(odd.exceptAll(even).withColumn("side", F.lit("compare")))
    return both.groupBy("side", F.md5("line").alias("line")).agg(F.count("*").alias("n"))


def channel_union(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.lit(0).alias("channel"), F.col("event_id").alias("id"), "event_type")
    orders = table(spark, d, "orders").select(F.lit(1).alias("channel"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return events.unionByName(orders, allowMissingColumns=True)


def covered_removal(spark: SparkSession, d: str) -> DataFrame:
    covered = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").join(covered, "doc_id", "left_anti").select("doc_id", "source")


def flag_list_union(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.col("p_type"), F.col("p_brand"))
    b = F.array(F.col("p_brand"), F.when(F.col("p_size") > 25, "LARGE").otherwise("SMALL"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.concat(a, b)), ",").alias("flags"))


def unresolved_separation(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    changes = events.where("value >= 20").select("event_id", F.lit("change").alias("kind"))
    return changes.unionByName(events.where("value < 20 or value is null").select("event_id", F.lit("observation").alias("kind")))


def low_confidence_sample(spark: SparkSession, d: str) -> DataFrame:
    """The fifty events of least value: a report of fixed length."""
    return table(spark, d, "events").where("event_type = 'error'").orderBy("value", "event_id").limit(50).select("event_id", "value")


def price_runs(spark: SparkSession, d: str) -> DataFrame:
    return islands(table(spark, d, "part"), ["p_brand"], F.col("p_size"), 2)


_PAGES = """with r as (select l_orderkey, avg(l_discount) as a, count(*) filter (where l_tax > 0.06) * 1.0 / count(*) as low, avg(l_quantity) as q from lineitem group by 1),
k as (select *, (low > 0.2)::int + (a < 0.03)::int + (q < 15)::int as risks from r)
select l_orderkey, case when risks >= 2 then 'UNRELIABLE' when low > 0.2 then 'LOW_TEXT' when a < 0.03 then 'LAYOUT' when q < 15 then 'THIN' else 'OK' end as status, round_even(1 - 0.2 * risks, 4)::double as score from k"""

QUERIES = {
    "event_change_counts": (event_change_counts, """select user_id, count(*) filter (where event_type in ('signup', 'purchase')) as "insert", count(*) filter (where event_type = 'error') as "delete",
  count(*) filter (where event_type = 'click') as change, count(*) filter (where event_type <> 'view') as total from events group by 1"""),
    "audit_stats": (audit_stats, "select event_type, count(*) filter (where value >= 50) as confirmed, count(*) filter (where value < 50) as needs_review, count(*) as total from events group by 1"),
    "quality_summary_flags": (quality_summary_flags, """with f as (select source, unnest(list_filter([case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end, case when length(text) < 200 then 'short' end,
  case when quality is null then 'unlabelled' end], lambda x: x is not null)) as flag from documents left join labels on documents.doc_id = labels.doc_id) select source, flag, count(*) as n from f group by 1, 2"""),
    "page_quality_status": (page_quality_status, _PAGES),
    "page_quality_rollup": (page_quality_rollup, f"""select o_custkey, arg_max(status, case status when 'UNRELIABLE' then 4 when 'LOW_TEXT' then 3 when 'LAYOUT' then 2 when 'THIN' then 1 else 0 end) as status,
  count(*) filter (where status <> 'OK') as risk_pages, count(*) as pages from ({_PAGES}) join orders on l_orderkey = o_orderkey group by 1"""),
    "document_profile_rollup": (document_profile_rollup, "select lang, source, count(*) as docs, sum(n_chars)::bigint as chars, grouping(lang, source)::bigint as level from documents group by rollup (lang, source)"),
    "clause_split_quality": (clause_split_quality, f"""with {_LINES}, t as (select doc_id, line, count(*) as c from lines group by 1, 2), r as (select doc_id, count(*) filter (where c > 1) as duplicate_lines from t group by 1)
select lines.doc_id, count(*) filter (where length(line) < 8) as short, count(*) filter (where length(line) > 1500) as long, min(length(line))::bigint as shortest, max(length(line))::bigint as longest,
  round_even(avg(length(line)), 4) as mean, any_value(duplicate_lines) as duplicate_lines from lines join r on lines.doc_id = r.doc_id group by 1"""),
    "score_histogram": (score_histogram, "select (p_size // 5)::bigint as bucket, count(*) as n from part group by 1"),
    "cross_source_dedup": (cross_source_dedup, """with f as (select doc_id, source, md5(lower(trim(text))) as f from documents), r as (select *, row_number() over (partition by f order by source, doc_id) as r from f),
m as (select f, string_agg(distinct source, ',' order by source) as merged_sources from f group by 1) select doc_id, source, merged_sources from r join m on r.f = m.f where r = 1"""),
    "informative_scalar_merge": (informative_scalar_merge, """with b as (select c_nationkey, c_mktsegment, row_number() over (partition by c_nationkey order by length(trim(c_mktsegment)) desc, c_mktsegment desc) as r from customer where trim(c_mktsegment) <> ''),
n as (select c_nationkey, count(distinct c_mktsegment) > 1 as c_mktsegment_conflict from customer group by 1) select n.c_nationkey, c_mktsegment, c_mktsegment_conflict from n left join b on n.c_nationkey = b.c_nationkey and r = 1"""),
    "spatial_overlap_dedup": (spatial_overlap_dedup, """with b as (select p_brand, p_partkey, p_partkey % 97 as x0, p_size * 2 as y0, p_partkey % 97 + 12 as x1, p_size * 2 + 6 + p_partkey % 3 as y1 from part)
select a.p_partkey as "left", c.p_partkey as "right" from b a join b c on a.p_brand = c.p_brand and a.p_partkey < c.p_partkey
where least(a.x1, c.x1) > greatest(a.x0, c.x0) and least(a.y1, c.y1) > greatest(a.y0, c.y0)
  and (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) >= 0.8 * least((a.x1 - a.x0) * (a.y1 - a.y0), (c.x1 - c.x0) * (c.y1 - c.y0))"""),
    "column_event_aggregation": (column_event_aggregation, """with r as (select l_orderkey, count(distinct l_linenumber) as n from lineitem group by 1),
c as (select l_orderkey, l_linenumber, 'discount' as "column" from lineitem where l_discount > 0.02 union all select l_orderkey, l_linenumber, 'tax' from lineitem where l_tax > 0.01 union all select l_orderkey, l_linenumber, 'quantity' from lineitem where l_quantity > 10),
e as (select l_orderkey, "column", count(distinct l_linenumber) as covered from c group by 1, 2) select e.l_orderkey, "column", covered from e join r on e.l_orderkey = r.l_orderkey where covered >= 2 and covered = n"""),
    "watermark_families": (watermark_families, f"""with {_LINES}, s as (select regexp_replace(lower(line), '[ .,|]', '', 'g') as family, line, count(*) as n from lines where length(line) <= 40 group by 1, 2),
r as (select *, row_number() over (partition by family order by n desc, length(line) desc, encode(line) desc) as r, sum(n) over (partition by family) as total from s) select family, total::bigint as n, line as representative from r where r = 1"""),
    "observation_aggregation": (observation_aggregation, "select source, case when bool_or(quality is null) then 'UNOBSERVED' when bool_or(quality = 1) then 'OBSERVED_VALUE' else 'OBSERVED_BLANK' end as state from documents left join labels on documents.doc_id = labels.doc_id group by 1"),
    "stage_timings": (stage_timings, 'select event_type, count(*) as "count", sum(value::decimal(20,4))::double as total, max(value) as "max" from events group by 1'),
    "contiguous_event_groups": (contiguous_event_groups, """with n as (select *, case when lag(event_type) over (partition by user_id order by event_id) <> event_type then 1 else 0 end as new from events),
g as (select *, sum(new) over (partition by user_id order by event_id) as g from n) select user_id, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from g group by user_id, event_type, g"""),
    "page_number_sequence": (page_number_sequence, """with p as (select *, row_number() over w as page, lag(o_orderkey) over w as a, lead(o_orderkey) over w as b from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, page, coalesce(abs(a - o_orderkey) < 2000, false) or coalesce(abs(b - o_orderkey) < 2000, false) as valid from p"""),
    "monotone_progress": (monotone_progress, "select event_id, least(99.0, max(value) over (partition by user_id order by event_id)) as progress from events"),
    "reading_order_conflicts": (reading_order_conflicts, """with b as (select *, lag(l_shipdate) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b from lineitem) select l_orderkey, count(*) filter (where b > l_shipdate) as conflicts from b group by 1"""),
    "dominant_position": (dominant_position, "with m as (select *, quantile_cont(p_size, 0.5) over (partition by p_brand) as m from part) select p_partkey, p_brand from m where abs(p_size - m) <= 4"),
    "median_centre": (median_centre, "select p_brand, median(p_size)::double as mid_size, round_even(median(p_retailprice), 4) as mid_price from part group by 1"),
    "records_page": (records_page, "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey desc limit 10 offset 20"),
    "records_totals": (records_totals, "select o_orderstatus, count(*) as total, ceil(count(*) / 10.0)::bigint as pages from orders group by 1"),
    "candidate_top5": (candidate_top5, "with r as (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_suppkey) as rank from lineitem) select l_partkey, rank, l_orderkey, l_extendedprice from r where rank <= 5"),
    "flat_multiset_diff": (flat_multiset_diff, f"""with {_LINES}, c as (select line, count(*) filter (where doc_id % 2 = 0) as e, count(*) filter (where doc_id % 2 = 1) as o from lines group by 1)
select case when e > o then 'original' else 'compare' end as side, md5(line) as line, abs(e - o) as n from c where e <> o"""),
    "channel_union": (channel_union, "select 0 as channel, event_id as id, event_type, null as o_orderstatus from events union all select 1, o_orderkey, null, o_orderstatus from orders"),
    "covered_removal": (covered_removal, "select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic = 1)"),
    "flag_list_union": (flag_list_union, "select p_partkey, p_type || ',' || p_brand || case when p_size > 25 and p_type <> 'LARGE' then ',LARGE' when p_size <= 25 and p_type <> 'SMALL' then ',SMALL' else '' end as flags from part"),
    "unresolved_separation": (unresolved_separation, "select event_id, case when value >= 20 then 'change' else 'observation' end as kind from events"),
    "low_confidence_sample": (low_confidence_sample, "select event_id, value from events where event_type = 'error' order by value, event_id limit 50"),
    "price_runs": (price_runs, """with v as (select distinct p_brand, p_size::bigint as v from part), r as (select *, v - row_number() over (partition by p_brand order by v) as g from v)
select p_brand, min(v) as first, max(v) as last, count(*) as n from r group by p_brand, g having count(*) >= 2"""),
}
