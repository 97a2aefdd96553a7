"""Queries of clause splitting, structural drift, text differences and the store. Orders and their lines stand for
clauses and messages; their texts are made so that the result can be said in SQL without the rules' own patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import diff, values
from concordia.operators import clauses as cl
from concordia.operators import drift as dr
from concordia.operators import lifecycle as lc
from concordia.operators import lines as ln
from concordia.sources import sinks
from concordia.sources.tables import shared_folder, table


def _pick(key: Column, *texts: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


_MARKERS = ("第三条", "1.2", "五", "（二）", "7", None)
_TITLES = ("", "付款", "x" * 30, "y" * 50, "z" * 90, "交货。")
_BLOCKS = ("paragraph_title", "text", "table")


def heading_scores(spark: SparkSession, d: str) -> DataFrame:
    """Units of all markers, titles and block types: how sure each opens a clause, and what speaks against it."""
    k = F.col("p_partkey")
    found = cl.heading_score(_pick(k, *_MARKERS), _pick(F.floor(k / 6), *_TITLES), _pick(F.floor(k / 36), *_BLOCKS), k % 5 == 0, k % 7 == 0, (k % 6 == 4) & (k % 2 == 0))
    return table(spark, d, "part").select("p_partkey", F.bround(found["score"], 6).alias("score"), F.array_join(found["risks"], ",").alias("risks"))


def clause_segmentation_by_marker(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as units: a numbered title opens a clause, so do the first unit and a new section."""
    n = F.col("l_linenumber")
    units = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("section"), F.max("l_partkey").alias("part"))
    score = cl.heading_score(F.when(F.col("part") % 3 == 0, "第二条").otherwise("7"), F.when(F.col("part") % 3 == 0, "付款").otherwise(""), F.lit("text"), F.lit(False), F.lit(False), F.lit(True))["score"]
    section = F.lag("section").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    units = units.withColumn("starts", cl.starts_clause(score, section.isNull(), section != F.col("section"))).withColumn("text", n.cast("string"))
    return ln.segments(units, ["l_orderkey"], "l_linenumber", F.col("starts"), "text").select("l_orderkey", "clause_seq", "first", "units", "text")


def clause_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of clauses with a path, with a number alone, and with neither."""
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.array(F.concat(F.lit("第"), (k % 9 + 1).cast("string"), F.lit("条 Terms")), F.concat((k % 4 + 1).cast("string"), F.lit("."), (k % 5).cast("string"), F.lit(" Pay")))).otherwise(F.array().cast("array<string>"))
    number = F.when(k % 3 == 1, F.concat((k % 7).cast("string"), F.lit(".2"))).otherwise("")
    text = F.concat(F.lit("Body of "), k.cast("string"), F.lit("\nmore"))
    key = cl.clause_key(F.when(k % 2 == 0, "appendix"), path, number, text)
    return table(spark, d, "orders").select("o_orderkey", key.alias("clause_key"))


def inline_marker_split(spark: SparkSession, d: str) -> DataFrame:
    """One block with markers of all styles, an amount and a number within it."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("甲方负责交货1.乙方付款（二）双方确认第"), k, F.lit("条违约责任十二、保密①附则价格3.5万元共计"), k, F.lit("个"))
    pieces = F.posexplode(cl.inline_pieces(text)).alias("place", "piece")
    return table(spark, d, "part").select("p_partkey", pieces).withColumn("place", F.col("place").cast("long"))


def short_noise(spark: SparkSession, d: str) -> DataFrame:
    """Short fragments by kind, place and confidence."""
    k = F.col("p_partkey")
    text = _pick(k, "ab", "3元", "甲方", "12", "#", "longer text", "…")
    y, x = (F.floor(k / 7) % 10 * 100).cast("double"), F.lit(300.0)
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + F.when(k % 3 == 0, 10.0).otherwise(90.0)).alias("x1"), (y + 12.0).alias("y1"))
    noise = cl.is_short_noise(text, box, F.when(k % 2 == 0, "ocr_line").otherwise("text"), F.when(k % 11 > 0, (k % 11) / 10.0), F.lit(600.0), F.lit(1000.0))
    return table(spark, d, "part").select("p_partkey", noise.alias("noise"))


def layout_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Texts with other line ends and punctuation, the same ones, short ones and really different ones."""
    k = F.col("o_orderkey").cast("string")
    a = F.when(F.col("o_orderkey") % 5 == 3, "ab\nc").otherwise(F.concat(F.lit("Pay within "), k, F.lit(" days,\nafter delivery")))
    other = (F.concat(F.lit("pay within "), k, F.lit("\ndays after delivery.")), F.concat(F.lit("PAY within "), k, F.lit(" days;\nafter delivery")), F.concat(F.lit("Pay within "), k, F.lit("1 days\nafter delivery")), F.lit("a\nbc"), F.concat(F.lit("Pay within "), k, F.lit(" days after delivery")))
    b = F.element_at(F.array(*other), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", diff.layout_equivalent(a, b).alias("same"))


def compaction(spark: SparkSession, d: str) -> DataFrame:
    """White-space runs and misread per-mille signs in one text, and where a range of the short text came from."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("rate "), k, F.lit("%o  a\t\n b "), k, F.lit("%. c %0 "), k, F.lit("%.x"))
    short = diff.compacted(text)
    back = diff.source_range(short["starts"], F.length(k) + 5, F.length(k) + 7)
    return table(spark, d, "part").select("p_partkey", short["text"].alias("text"), back["start"].cast("long").alias("start"), back["end"].cast("long").alias("end"))


def _needle() -> Column:
    return F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" of part "), F.col("l_partkey").cast("string"))


def merged_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as clauses; the even ones were merged into one text, with other spacing."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    needles = lines.select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("order"), F.lit("").alias("section_type"), _needle().alias("text"))
    even = F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == 0, F.struct("l_linenumber", F.regexp_replace(_needle(), " of ", "\n of\t").alias("t")))))
    hays = lines.groupBy(F.col("l_orderkey").alias("pair")).agg(F.concat(F.lit("terms: "), F.array_join(F.transform(even, lambda s: s["t"]), "; "), F.lit(".")).alias("text"))
    hays = hays.select("pair", F.lit(0).alias("id"), F.lit(0).alias("order"), F.lit("main_contract").alias("section_type"), "text")
    found = dr.merged_clauses(needles, hays).join(hays.select("pair", "text"), "pair")
    return found.select("pair", F.col("id").cast("long").alias("id"), F.col("start").cast("long").alias("start"), "slice_id", dr.sliced(F.col("text"), F.col("start"), F.col("end")).alias("slice"))


def redacted_clauses(spark: SparkSession, d: str) -> DataFrame:
    """A text without overlapping, touching, empty and far spans."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("  keep"), k.cast("string"), F.lit("|cut one|keep|two"))
    n = F.length(k.cast("string"))
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    spans = F.array(span(n + 10, n + 14), span(n + 6, n + 11), span(F.lit(3), F.lit(3)), span(n + 19, F.lit(99)))
    return table(spark, d, "part").select("p_partkey", dr.redacted(text, spans).alias("kept"), dr.redacted(text, F.array(span(F.lit(0), F.lit(99)))).alias("nothing"))


def swallowed_headings(spark: SparkSession, d: str) -> DataFrame:
    """Each order as a heading and a body that matched a clause with both; in some the title or the body differs."""
    k = F.col("o_orderkey")
    of = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("order", "id", "number", "title", "text", "compare_id", "compare_number", "compare_title", "compare_text"), strict=True)])
    none = F.lit(None).cast("string")
    body = F.concat(F.lit("pay "), k.cast("string"), F.lit(" now"))
    heading = of(F.lit(1), F.lit("h"), F.lit("1"), F.lit("Terms"), F.lit("1 Terms"), none, none, none, none)
    other = F.when(k % 4 == 0, "Other").otherwise("terms")
    clause = of(F.lit(2), F.lit("b"), F.when(k % 7 == 0, "2").otherwise(""), F.lit(""), body, F.lit("c"), F.lit("3"), other, F.concat(F.lit("3 "), other, F.lit("\npay  "), k.cast("string"), F.when(k % 3 == 0, " later").otherwise(" now")))
    rows = table(spark, d, "orders").select(k.alias("pair"), F.explode(F.array(heading, clause)).alias("c")).select("pair", "c.*").withColumns({"section_type": F.lit(""), "compare_type": F.lit("main_contract")})
    return dr.swallowed_headings(rows).select("pair", "heading_id", "compare_id", "heading", "body")


def page_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, lines as blocks: those that one side has alone."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    blocks = table(spark, d, "lineitem").select("l_orderkey", q.alias("chars"), F.lit(10.0).alias("x0"), (n * 50.0).alias("y0"), (q * 8 + 10).alias("x1"), (n * 50.0 + 40).alias("y1"), F.lit(400.0).alias("width"), F.lit(400.0).alias("height"), q.alias("weight"), F.when(F.col("l_returnflag") != "N", 1.0).otherwise(0.5).alias("coverage"), (F.col("l_orderkey") % 4 == 0).alias("aligned"))
    return dr.promoted_pages(blocks, ["l_orderkey"]).select("l_orderkey", F.bround("covered", 6).alias("covered"))


def date_precision(spark: SparkSession, d: str) -> DataFrame:
    """Dates to the day, to the month, with blanks, with three digits, and days that no month has."""
    k = F.col("o_orderkey")
    year, month = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")
    text = F.when(k % 5 == 0, F.concat(year, F.lit("年 "), month, F.lit("月"))).when(k % 5 == 1, F.concat(year, F.lit("年"), month, F.lit("月"), F.dayofmonth("o_orderdate").cast("string"), F.lit(" 日")))
    text = text.when(k % 5 == 2, F.concat(F.substring(year, 1, 3), F.lit("年"), month, F.lit("月"))).when(k % 5 == 3, F.concat(year, F.lit("年2月30日"))).otherwise(F.concat(year, F.lit("-"), month))
    return table(spark, d, "orders").select("o_orderkey", values.date_precision(text).alias("precision"))


def read_modify_write(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks with an owner; a patch for every third one, some of which would change the owner."""
    k = F.col("o_orderkey")
    state = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("revision"))
    patches = table(spark, d, "orders").where(k % 3 == 0).select("o_orderkey", F.when(k % 2 == 0, F.col("o_custkey")).when(k % 5 == 0, F.col("o_custkey") + 1).alias("owner"), F.when(k % 9 > 0, "DONE").alias("status"))
    return lc.mutate(state, patches, "o_orderkey", "owner").select("o_orderkey", "owner", "status", F.col("revision").cast("long").alias("revision"), "refused")


def progress_frames(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as server-sent events, up to the first purchase."""
    found = lc.event_frames(table(spark, d, "events"), "user_id", "event_id", "ts", ["user_id", "event_id", "event_type"], "event_type", ["purchase"])
    return found.select("user_id", "event_id", "keepalives", F.md5("frame").alias("frame"))


def call_observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls of a stage."""
    e = F.col("event_id")
    calls = table(spark, d, "events").select("event_type", (e % 3 == 0).alias("cache_hit"), (e % 5 == 0).alias("retry"), F.when(e % 7 == 0, "error").otherwise("ok").alias("outcome"), (e % 4).alias("inputs"), (e % 8 / 4).alias("seconds"))
    return lc.observations(calls, ["event_type"])


def artifact_sink(spark: SparkSession, d: str) -> DataFrame:
    """Nations written twice to one place: what is read back is the second write, whole, as JSON lines."""
    path = sinks.artifact_path(f"{shared_folder(spark)}/concordia", f"artifact-{uuid.uuid4().hex}", "nations.json")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    sinks.write_debug(nations.limit(0), path)
    return sinks.write_debug(nations, path)


QUERIES = {
    "heading_scores": (heading_scores, """with r as (select p_partkey as k, p_partkey % 6 as m, p_partkey // 6 % 6 as t, p_partkey // 36 % 3 as b, p_partkey % 5 = 0 as business, p_partkey % 7 = 0 as dated from part),
n as (select *, ([0, 2, 30, 50, 90, 3])[t + 1] as n, ([0.34, 0.34, 0.30, 0.20, 0.16, 0]::double[])[m + 1] as style, m = 4 and k % 2 = 0 and not (b = 0 and t in (1, 5)) as doubtful from r),
s as (select *, 0.42::double + style + case when n between 2 and 36 then 0.12 when n in (50, 90) and m = 1 then 0.04 when n = 0 then -0.14 when n > 80 then -0.18 else 0 end::double + case when b = 0 then 0.08 else 0 end::double + case when business then 0.06 else 0 end::double
  + case when m = 4 and business then 0.08 else 0 end::double - case when t = 5 then 0.1 else 0 end::double - case when dated then 0.3 else 0 end::double as s from n)
select k as p_partkey, case when m = 5 then case when b = 0 and n > 0 then case when business then 0.82 else 0.74 end end when b = 2 then null else round_even(greatest(0, least(1, case when doubtful then least(s, 0.55) else s end)), 6) end::double as score,
  case when m = 5 then case when b = 0 and n > 0 then '' end when b < 2 then array_to_string(list_filter([case when n = 0 then 'WEAK_HEADING' when n > 80 and m <> 1 then 'LONG_HEADING' end, case when t = 5 then 'PUNCTUATED_HEADING' end, case when dated then 'DATE_LIKE_HEADING' end,
    case when doubtful then 'WEAK_NUMERIC_MARKER' end], lambda x: x is not null), ',') end as risks from s"""),
    "clause_segmentation_by_marker": (clause_segmentation_by_marker, """with u as (select l_orderkey, l_linenumber as n, min(l_returnflag) as section, max(l_partkey) as part from lineitem group by 1, 2),
s as (select *, case when part % 3 = 0 or lag(section) over w is null or lag(section) over w <> section then 1 else 0 end as opens from u window w as (partition by l_orderkey order by n)),
g as (select *, sum(opens) over (partition by l_orderkey order by n) as clause_seq from s)
select l_orderkey, clause_seq::bigint as clause_seq, min(n) as first, count(*) as units, string_agg(n::varchar, chr(10) order by n) as text from g group by 1, 2"""),
    "clause_keys": (clause_keys, """select o_orderkey, case when o_orderkey % 2 = 0 then 'appendix' else 'main_contract' end || '/' || case o_orderkey % 3 when 0 then 'n' || (o_orderkey % 9 + 1) || 'terms/n' || (o_orderkey % 4 + 1) || '_' || (o_orderkey % 5) || 'pay'
  when 1 then 'n' || (o_orderkey % 7) || '_2' else 'bodyof' || o_orderkey end as clause_key from orders"""),
    "inline_marker_split": (inline_marker_split, """with p as (select p_partkey, ['甲方负责交货', '1.乙方付款', '（二）双方确认', '第' || p_partkey || '条违约责任', '十二、保密', '①附则价格3.5万元共计' || p_partkey || '个'] as p from part)
select p_partkey, i - 1 as place, p[i] as piece from p, range(1, 7) r(i)"""),
    "short_noise": (short_noise, """with r as (select p_partkey as k, p_partkey % 7 as t, p_partkey // 7 % 10 * 100 as y, p_partkey % 2 = 0 as line, p_partkey % 3 = 0 as tiny, p_partkey % 11 between 1 and 6 as unsure from part),
e as (select *, line and (y + 12 <= 80 or y >= 920) as ends from r)
select k as p_partkey, case t when 0 then (line and unsure) or ends or (tiny and unsure) when 3 then ends or (tiny and unsure) when 4 then ends or (tiny and unsure) when 6 then ends or (tiny and unsure) else false end as noise from e"""),
    "layout_equivalence": (layout_equivalence, "select o_orderkey, o_orderkey % 5 in (0, 4) as same from orders"),
    "compaction": (compaction, """select p_partkey, 'rate ' || p_partkey || '‰ a b ' || p_partkey || '%. c %0 ' || p_partkey || '‰x' as text, (length(p_partkey::varchar) + 5)::bigint as start, (length(p_partkey::varchar) + 9)::bigint as "end" from part"""),
    "merged_clauses": (merged_clauses, """with l as (select l_orderkey as pair, l_linenumber as id, 'Line ' || l_linenumber || chr(10) || ' of' || chr(9) || 'part ' || max(l_partkey) as t from lineitem where l_linenumber % 2 = 0 group by 1, 2),
n as (select *, count(*) over (partition by pair) as n, row_number() over (partition by pair order by id) as r, 7 + coalesce(sum(length(t) + 2) over (partition by pair order by id rows between unbounded preceding and 1 preceding), 0) as start from l)
select pair, id::bigint as id, start::bigint as start, '0M' || lpad(r::varchar, 2, '0') as slice_id, t as slice from n where n >= 2"""),
    "redacted_clauses": (redacted_clauses, "select p_partkey, 'keep' || p_partkey || '|keep' as kept, null::varchar as nothing from part"),
    "swallowed_headings": (swallowed_headings, """select o_orderkey as pair, 'h' as heading_id, 'c' as compare_id, '3 terms' as heading, 'pay  ' || o_orderkey || ' now' as body from orders where o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0 and o_orderkey % 7 <> 0"""),
    "page_promotion": (page_promotion, """select l_orderkey, round_even(sum(l_quantity * case when l_returnflag <> 'N' then 1 else 0.5 end) / sum(l_quantity), 6) as covered from lineitem where l_orderkey % 4 <> 0 group by 1
having count(*) >= 2 and sum(l_quantity) >= 80 and max(l_quantity) * 8 * (max(l_linenumber) * 50 + 40 - min(l_linenumber) * 50) / 160000 >= 0.18 and sum(l_quantity * case when l_returnflag <> 'N' then 1 else 0.5 end) / sum(l_quantity) >= 0.82"""),
    "date_precision": (date_precision, "select o_orderkey, case o_orderkey % 5 when 0 then 'month' when 1 then 'day' end as precision from orders"),
    "read_modify_write": (read_modify_write, """with r as (select *, o_orderkey % 3 = 0 as p, o_orderkey % 3 = 0 and o_orderkey % 2 <> 0 and o_orderkey % 5 = 0 as refused from orders)
select o_orderkey, o_custkey as owner, case when p and not refused and o_orderkey % 9 > 0 then 'DONE' else o_orderstatus end as status, case when p and not refused then 2 else 1 end::bigint as revision, refused from r"""),
    "progress_frames": (progress_frames, """with e as (select *, coalesce(max((event_type = 'purchase')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as ended, floor(epoch(ts::timestamp)) as s from events),
g as (select *, s - lag(s) over (partition by user_id order by event_id) as gap from e)
select user_id, event_id, coalesce(floor(gap / 30), 0)::bigint as keepalives, md5('data: {"user_id":' || user_id || ',"event_id":' || event_id || ',"event_type":"' || event_type || '"}' || chr(10) || chr(10)) as frame from g where ended = 0"""),
    "call_observations": (call_observations, """select event_type, count(*) filter (where event_id % 3 <> 0) as attempts, count(*) filter (where event_id % 5 = 0) as retries, coalesce(sum(event_id % 4) filter (where event_id % 3 = 0), 0)::bigint as cached_inputs,
  count(*) filter (where event_id % 7 = 0) as failures, coalesce(sum(event_id % 8 / 4.0::double) filter (where event_id % 3 <> 0), 0)::double as seconds from events group by 1"""),
    "artifact_sink": (artifact_sink, "select n_nationkey, n_name, nullif(n_regionkey, 0) as region from nation"),
}
