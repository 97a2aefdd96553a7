"""Queries of evidence, regions, fields, ingest checks and event views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import values
from concordia.operators import aggregates as ag
from concordia.operators import cells as ce
from concordia.operators import evidence as ev
from concordia.operators import lifecycle as lc
from concordia.operators import lines as ln
from concordia.plans.line_queries import _LINES, _lines
from concordia.sources.tables import ordered_table, table


def windowed_scan(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as pages, read in windows of ten that overlap by one; the first reading stays."""
    pages = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    read = pages.withColumn("window", F.explode(ev.windows_of(F.col("page"), 10, 1)))
    first = F.row_number().over(Window.partitionBy("o_custkey", "page").orderBy("window"))
    kept = read.withColumn("_n", first).where("_n = 1")
    return kept.groupBy("o_custkey", "window").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


def event_export(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("json"))


def ingest_validation(spark: SparkSession, d: str) -> DataFrame:
    """Bodies as base64: too large, without the magic opening, or accepted with their digest."""
    posted = table(spark, d, "pages").select("page_id", F.base64(F.col("html").cast("binary")).alias("body"))
    raw = F.unbase64("body")
    reason = ln.first_reason(("too_large", F.length(raw) > 4000), ("bad_magic", ~F.decode(F.substring(raw, 1, 9), "UTF-8").startswith("<!DOCTYPE")), default="accepted")
    return posted.select("page_id", reason.alias("status"), F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("digest"))


def remediation_plan(spark: SparkSession, d: str) -> DataFrame:
    """The first flag by priority names the action; one action a source and target."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    action = ln.first_reason(("REDACT", F.col("toxic") == 1), ("RESCAN", F.col("quality") == 0), ("RELABEL", F.col("quality").isNull()), default="NONE")
    planned = docs.select("source", "lang", action.alias("action")).where("action <> 'NONE'")
    return planned.groupBy("source", "lang", "action").agg(F.count("*").alias("pages"), lc.identity("A-", F.col("source"), F.col("lang"), F.col("action")).alias("action_id"))


def legacy_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Old rows without a status, reason or revision get the defaults of their state."""
    old = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(2)).alias("revision"))
    status = F.coalesce("status", F.lit("P"))
    return old.select("o_orderkey", status.alias("status"), F.when(status == "F", "UNKNOWN").otherwise("NONE").alias("reason"), F.coalesce("revision", F.lit(1)).cast("long").alias("revision"))


def model_route(spark: SparkSession, d: str) -> DataFrame:
    page = F.when(F.col("quality") == 0, "RISK").when(F.length("text") > 8000, "LONG").when(F.col("text").contains("|"), "TABLE").otherwise("PLAIN")
    model = F.element_at(F.create_map(*[F.lit(x) for x in ("RISK", "strong", "LONG", "windowed", "TABLE", "table", "PLAIN", "none")]), page)
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", page.alias("page_type"), model.alias("model"), F.lit(False).alias("should_execute"))


def header_footer_slots(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines of documents by slot, where a source repeats them."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    window = Window.partitionBy("doc_id")
    lines = _lines(spark, d).withColumn("_first", F.min("line_no").over(window)).withColumn("_last", F.max("line_no").over(window))
    slot = F.when(F.col("line_no") == F.col("_first"), "header").when(F.col("line_no") == F.col("_last"), "footer")
    rows = lines.withColumn("slot", slot).where("slot is not null").join(docs, "doc_id")
    return rows.groupBy("source", "slot", F.md5(F.lower("line")).alias("line")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def page_risk_join(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of events on pages (orders) whose quality is not OK."""
    lines = ag.ordered_means(ordered_table(spark, d, "lineitem", "l_orderkey", "l_discount"), ["l_orderkey"], ["_file", "_row"], {"_a": "l_discount"})
    risky = lines.where("_a < 0.03").select(F.col("l_orderkey").alias("page"))
    sides = F.array(F.struct(F.lit("original").alias("side"), F.col("event_id").alias("page")), F.struct(F.lit("compare").alias("side"), (F.col("event_id") + F.col("user_id")).alias("page")))
    evidence = table(spark, d, "events").select("event_id", F.explode(sides).alias("e")).select("event_id", "e.*")
    return evidence.join(risky, "page").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("side")), ",").alias("sides"))


def audit_context(spark: SparkSession, d: str) -> DataFrame:
    """Each order line with its order's context, else its part's, else none, and the scope that gave it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    item = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("_item"))
    diff = table(spark, d, "part").where("p_size > 30").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("_diff"))
    joined = lines.join(item, "l_orderkey", "left").join(diff, "l_partkey", "left")
    scope = F.when(F.col("_item").isNotNull(), "ITEM").when(F.col("_diff").isNotNull(), "DIFF").otherwise("NONE")
    return joined.groupBy(scope.alias("scope"), F.coalesce("_item", "_diff").alias("context")).agg(F.count("*").alias("n"))


def page_counter_match(spark: SparkSession, d: str) -> DataFrame:
    """Counters that stand once on either side."""
    parts = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), F.col("p_size")).alias("counter"))
    once = lambda df, name: df.groupBy("counter").agg(F.min("p_partkey").alias(name), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return once(parts.where("p_partkey % 2 = 0"), "original").join(once(parts.where("p_partkey % 2 = 1"), "compare"), "counter")


def region_counterpart(spark: SparkSession, d: str) -> DataFrame:
    """The best box of a part near a supplier's box, where it leads the next best by a margin."""
    regions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("region"), (F.col("s_nationkey") * 2.0).alias("x"), (F.col("s_suppkey") % 40 * 1.0).alias("y"))
    blocks = table(spark, d, "part").select(F.col("p_partkey").alias("block"), (F.col("p_partkey") % 50 * 1.0).alias("x"), (F.col("p_size") * 1.0).alias("y"))
    return ev.counterparts(regions, blocks, "region", "block", 3.0, 0.05)


def evidence_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Readings of a brand's parts by two sources: agreement within and across."""
    rows = table(spark, d, "part").where("p_size <= 12").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, "original").otherwise("compare").alias("side"), F.col("p_type").alias("reading"))
    return ev.consensus(rows, ["p_brand"], "side", "reading")


def text_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Why two writings of a price count as the same, or that they do not."""
    price = F.format_string("%.2f", "o_totalprice")
    kind = F.col("o_orderkey") % 5
    other = F.when(kind == 0, price).when(kind == 1, F.concat(F.lit(" "), price, F.lit(" "))).when(kind == 2, F.concat(F.lit("("), price, F.lit(")"))).when(kind == 3, F.concat(price, F.lit("%"))).otherwise(F.concat(F.lit("1"), price))
    return table(spark, d, "orders").select("o_orderkey", ev.equivalence(price, other).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def critical_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Typed tokens that stand on one side only."""
    orders = table(spark, d, "orders")
    text = lambda days: F.concat(F.lit("within "), days.cast("string"), F.lit(" days pay $"), F.format_string("%.2f", "o_totalprice"))
    a, b = values.business_tokens(text(F.col("o_custkey") % 4)), values.business_tokens(text(F.col("o_custkey") % 3))
    return orders.select("o_orderkey", F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("gone"), F.array_join(F.array_sort(F.array_except(b, a)), ",").alias("new")).where("gone <> new")


def evidence_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Words of a passage as boxes: a line's box split evenly over its characters, runs joined."""
    return ev.word_boxes(table(spark, d, "benchmark"), "item_id", "text", 0.0, 600.0)


def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two payloads of a user merged key by key: the larger value wins, a conflict is told."""
    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    side = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.create_map(F.lit("k"), F.max(k), F.lit("n"), F.count("*")).alias("m"))
    a, b = side("click").withColumnRenamed("m", "a"), side("view").withColumnRenamed("m", "b")
    both = a.join(b, "user_id")
    merged = F.map_zip_with("a", "b", lambda _, x, y: F.greatest(x, y))
    return both.select("user_id", merged["k"].alias("k"), merged["n"].alias("n"), (F.col("a")["k"] != F.col("b")["k"]).alias("conflict"))


def grid_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Orders as one-row HTML tables with spans, scanned and laid on the grid."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    cell = F.concat(F.lit('<td colspan="'), (F.col("l_linenumber") % 3 + 1).cast("string"), F.lit('">'), F.col("p").cast("string"), F.lit("</td>"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("c")))), lambda r: r["c"]), "")
    tables = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<table><tr>"), row, F.lit("</tr></table>")).alias("html"))
    return ce.expand_spans(ce.html_cells(tables, "l_orderkey", "html"), "l_orderkey").select("l_orderkey", "row", "col", "text", "anchor")


def row_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of flags that several lines of an order share."""
    signature = F.concat_ws("|", "l_returnflag", "l_linestatus", (F.col("l_discount") > 0.05).cast("string"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", signature.alias("signature")).agg(F.count("*").alias("n")).where("n > 1")


def layout_shift(spark: SparkSession, d: str) -> DataFrame:
    """Values of an order that stand in another column on the other side."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("value"))
    shifted = lines.withColumn("_c", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")))
    once = F.count("*").over(Window.partitionBy("l_orderkey", "value"))
    a = lines.withColumn("_n", once).where("_n = 1").select("l_orderkey", "value", F.col("l_linenumber").alias("original_col"))
    b = shifted.withColumn("_n", once).where("_n = 1").select("l_orderkey", "value", F.col("_c").alias("compare_col"))
    return a.join(b, ["l_orderkey", "value"]).where("original_col <> compare_col")


def cell_change_groups(spark: SparkSession, d: str) -> DataFrame:
    """Changed lines of an order as one difference with its members in order."""
    changed = table(spark, d, "lineitem").where("l_discount > 0.07").select("l_orderkey", "l_linenumber").distinct()
    return changed.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("cells"), F.count("*").alias("n"))


def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose stated total their lines cover, fall short of or pass."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).alias("lines"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    total = F.col("o_totalprice").cast("decimal(20,2)")
    state = F.when(F.col("lines") > total, "PASSED").when(F.col("lines") < total, "SHORT").otherwise("COVERED")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("lines").cast("double").alias("lines"))


def cover_fields(spark: SparkSession, d: str) -> DataFrame:
    """Label lines of two versions of a customer's cover page, parsed and compared key by key."""
    page = lambda name, segment: F.concat_ws("\n", F.concat(F.lit("Name: "), name), F.concat(F.lit("Segment ： "), segment), F.concat(F.lit("Nation:"), F.col("c_nationkey").cast("string")))
    customers = table(spark, d, "customer")
    a = ev.label_fields(customers.select("c_custkey", page(F.col("c_name"), F.col("c_mktsegment")).alias("text")), "c_custkey", "text")
    b = ev.label_fields(customers.where("c_custkey % 9 <> 0").select("c_custkey", page(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise("NONE")).alias("text")), "c_custkey", "text")
    return ce.cell_changes(a, b, ["c_custkey", "label"], "value", F.lower("value"))


def event_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous one-sided events as one, with a direction, members and a stable id."""
    window = Window.partitionBy("user_id").orderBy("event_id")
    events = table(spark, d, "events").withColumn("side", F.when(F.col("value") >= 50, "compare").otherwise("original"))
    rows = events.withColumn("_new", F.coalesce((F.lag("side").over(window) != F.col("side")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_g", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("user_id", "_g", "side").agg(F.min("event_id").alias("first"), F.count("*").alias("members"))
    return found.select("user_id", "first", F.when(F.col("side") == "compare", "ADD").otherwise("DELETE").alias("direction"), "members", lc.identity("E-", F.col("user_id"), F.col("first")).alias("id"))


def review_projection(spark: SparkSession, d: str) -> DataFrame:
    """A user's review status from its items: one status for all, or mixed."""
    status = F.when(F.col("value") > 70, "CONFIRMED").when(F.col("value") < 5, "IGNORED").otherwise("PENDING")
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.count_distinct(status).alias("_n"), F.min(status).alias("_s"))
    return kinds.select("user_id", F.when(F.col("_n") > 1, "NEEDS_REVIEW").otherwise(F.col("_s")).alias("status"))


def glyph_regions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as glyphs; the region of their part's brand that owns their centre, the first by size."""
    glyphs = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    glyphs = glyphs.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand", F.col("l_quantity").alias("c"))
    # Of regions at the same place the first owns all: one for each brand and size.
    regions = table(spark, d, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("lo")).agg(F.min("p_partkey").alias("region"))
    owned = glyphs.join(regions, "p_brand").where("c >= lo and c < lo + 8")
    best = owned.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c").agg(F.min(F.struct("lo", "region")).alias("_o"))
    return best.groupBy(F.col("_o.region").alias("region")).agg(F.count("*").alias("glyphs"))


def conservation_check(spark: SparkSession, d: str) -> DataFrame:
    """Every line is accounted for once after documents are split and joined again."""
    lines = _lines(spark, d).select("doc_id", "line")
    joined = _lines(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]).alias("l"))
    again = joined.select("doc_id", F.explode(F.split(F.array_join("l", "\n"), "\n")).alias("line"))
    lost, made = lines.exceptAll(again).agg(F.count("*").alias("lost")), again.exceptAll(lines).agg(F.count("*").alias("made"))
    return lost.join(made, F.lit(True))


def baseline_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a brand rejoined to lines where their heights touch."""
    boxes = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 3.0).alias("lo"), (F.col("p_size") * 3.0 + F.col("p_partkey") % 4).alias("hi"))
    return ce.interval_clusters(boxes, ["p_brand"], "lo", "hi", 0.5, "line", ("p_partkey",)).groupBy("p_brand", "line").agg(F.count("*").alias("boxes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def direction_decision(spark: SparkSession, d: str) -> DataFrame:
    """The reading angle of a part by its scores: enough valid ones, straight kept, else a clear lead."""
    angle = F.col("l_linenumber") % 4 * 90
    scores = table(spark, d, "lineitem").groupBy("l_partkey", angle.alias("angle")).agg(F.bround(F.avg("l_discount"), 6).alias("score"), F.count("*").alias("valid"))
    return ev.direction(scores, "l_partkey")


def code_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Two codes that differ in exactly one place by characters that look alike."""
    code = F.upper(F.substring(F.md5(F.col("n_name")), 1, 18))
    other = F.when(F.col("n_nationkey") % 3 == 0, F.regexp_replace(code, "^(.{4}).", "$1O")).when(F.col("n_nationkey") % 3 == 1, F.translate(code, "05", "OS")).otherwise(code)
    return table(spark, d, "nation").select("n_nationkey", ev.ambiguous_codes(code, other).alias("ambiguous"))


def party_spans(spark: SparkSession, d: str) -> DataFrame:
    """Turns owned by the last user turn, until a system turn clears it."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("role").isin("user", "system"), F.struct("turn", "role"))).over(window)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(last["role"] == "user", last["turn"]).alias("party_turn"))


def recognition_disagreement(spark: SparkSession, d: str) -> DataFrame:
    readings = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("readings"))
    return readings.select("l_partkey", F.when(F.col("readings") > 1, "NEEDS_REVIEW").otherwise("STABLE").alias("status"))


def valid_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x0"), F.lit(1.0).alias("y0"), (F.col("p_size") + F.col("p_partkey") % 5 - 1.0).alias("x1"), F.when(F.col("p_partkey") % 7 > 0, 2.0).alias("y1"))
    return rows.where(ev.valid_box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])).select("p_partkey")


def table_stitch(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as tables on pages: equal headers on the next page go on."""
    pages = table(spark, d, "orders").withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    rows = ce.stitch_tables(pages.select("o_custkey", "page", "o_orderstatus"), "o_custkey", "page", "o_orderstatus")
    return rows.groupBy("o_custkey", "table_group").agg(F.min("page").alias("first_page"), F.count("*").alias("pages"))


def event_session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user's events with gaps under six hours."""
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return rows.select("user_id", "first", "n")


QUERIES = {
    "windowed_scan": (windowed_scan, """with p as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as page from orders)
select o_custkey, greatest(0, ceil((page - 10) / 9.0))::bigint as "window", min(page) as first_page, max(page) as last_page, count(*) as pages from p group by 1, 2"""),
    "event_export": (event_export, """select event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as json from events"""),
    "ingest_validation": (ingest_validation, "select page_id, case when strlen(html) > 4000 then 'too_large' when not starts_with(html, '<!DOCTYPE') then 'bad_magic' else 'accepted' end as status, strlen(html)::bigint as n_bytes, sha256(html) as digest from pages"),
    "remediation_plan": (remediation_plan, """with a as (select source, lang, case when toxic = 1 then 'REDACT' when quality = 0 then 'RESCAN' when quality is null then 'RELABEL' else 'NONE' end as action from documents left join labels on documents.doc_id = labels.doc_id)
select source, lang, action, count(*) as pages, 'A-' || sha256('{"k0":"' || source || '","k1":"' || lang || '","k2":"' || action || '"}')[1:24] as action_id from a where action <> 'NONE' group by 1, 2, 3"""),
    "legacy_coercion": (legacy_coercion, "select o_orderkey, case when o_orderkey % 3 > 0 then o_orderstatus else 'P' end as status, case when o_orderkey % 3 > 0 and o_orderstatus = 'F' then 'UNKNOWN' else 'NONE' end as reason, case when o_orderkey % 5 = 0 then 2 else 1 end::bigint as revision from orders"),
    "model_route": (model_route, """with p as (select documents.doc_id, case when quality = 0 then 'RISK' when length(text) > 8000 then 'LONG' when contains(text, '|') then 'TABLE' else 'PLAIN' end as page_type from documents left join labels on documents.doc_id = labels.doc_id)
select doc_id, page_type, case page_type when 'RISK' then 'strong' when 'LONG' then 'windowed' when 'TABLE' then 'table' else 'none' end as model, false as should_execute from p"""),
    "header_footer_slots": (header_footer_slots, f"""with {_LINES}, m as (select *, min(line_no) over (partition by doc_id) as f, max(line_no) over (partition by doc_id) as l from lines),
s as (select source, doc_id, line, case when line_no = f then 'header' when line_no = l then 'footer' end as slot from m) select source, slot, md5(lower(line)) as line, count(*) as n, min(doc_id) as first from s where slot is not null group by 1, 2, 3 having count(*) > 1"""),
    "page_risk_join": (page_risk_join, """with r as (select l_orderkey from lineitem group by 1 having avg(l_discount) < 0.03), e as (select event_id, 'original' as side, event_id as page from events union all select event_id, 'compare', event_id + user_id from events)
select event_id, string_agg(distinct side, ',' order by side) as sides from e join r on page = l_orderkey group by 1"""),
    "audit_context": (audit_context, """with j as (select case when o_orderstatus = 'P' then o_orderpriority end as i, case when p_size > 30 then p_brand end as p from lineitem left join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey)
select case when i is not null then 'ITEM' when p is not null then 'DIFF' else 'NONE' end as scope, coalesce(i, p) as context, count(*) as n from j group by 1, 2"""),
    "page_counter_match": (page_counter_match, """with c as (select p_partkey, p_brand || '-' || p_size as counter from part), a as (select counter, min(p_partkey) as original from c where p_partkey % 2 = 0 group by 1 having count(*) = 1),
b as (select counter, min(p_partkey) as compare from c where p_partkey % 2 = 1 group by 1 having count(*) = 1) select a.counter, original, compare from a join b on a.counter = b.counter"""),
    "region_counterpart": (region_counterpart, """with s as (select s_suppkey as region, p_partkey as block, round_even(1 - (abs(s_nationkey * 2.0::double - p_partkey % 50) + abs(s_suppkey % 40 - p_size)) / 6.0::double, 6) as score from supplier join part on abs(s_nationkey * 2 - p_partkey % 50) <= 3 and abs(s_suppkey % 40 - p_size) <= 3),
r as (select *, row_number() over w as r, lead(score) over w as next from s window w as (partition by region order by score desc, block)) select region, block, score from r where r = 1 and (next is null or score - next >= 0.05)"""),
    "evidence_consensus": (evidence_consensus, """with r as (select p_brand, list_sort(list(distinct p_type) filter (where p_partkey % 2 = 0)) as a, list_sort(list(distinct p_type) filter (where p_partkey % 2 = 1)) as b from part where p_size <= 12 group by 1)
select p_brand, case when a is null or b is null then 'UNKNOWN' when len(a) > 1 or len(b) > 1 then 'CONFLICT' when a = b then 'EQUIVALENT' else 'DIFFERENT' end as consensus from r"""),
    "text_equivalence": (text_equivalence, "select case o_orderkey % 5 when 0 then 'IDENTICAL' when 1 then 'WHITE_SPACE' when 2 then 'PUNCTUATION' when 3 then 'PROTECTED_SIGN' else 'DIFFERENT' end as reason, count(*) as n, min(o_orderkey) as first from orders group by 1"),
    "critical_tokens": (critical_tokens, "select o_orderkey, 'term:' || o_custkey % 4 || 'days' as gone, 'term:' || o_custkey % 3 || 'days' as new from orders where o_custkey % 4 <> o_custkey % 3"),
    "evidence_boxes": (evidence_boxes, """with c as (select item_id, length(text) as n, i - 1 as p from benchmark, range(1, length(text) + 1) r(i) where text[i:i] <> ' '), g as (select *, p - row_number() over (partition by item_id order by p) as g from c)
select item_id, min(p)::bigint as start, (max(p) + 1)::bigint as "end", round_even(600.0::double * min(p) / any_value(n), 4) as x0, round_even(600.0::double * (max(p) + 1) / any_value(n), 4) as x1 from g group by item_id, g"""),
    "json_merge": (json_merge, """with a as (select user_id, max((props::json->>'k')::bigint) as k, count(*) as n from events where event_type = 'click' group by 1), b as (select user_id, max((props::json->>'k')::bigint) as k, count(*) as n from events where event_type = 'view' group by 1)
select a.user_id, greatest(a.k, b.k) as k, greatest(a.n, b.n) as n, a.k <> b.k as conflict from a join b on a.user_id = b.user_id"""),
    "grid_expansion": (grid_expansion, """with l as (select l_orderkey, l_linenumber, max(l_partkey) as p from lineitem group by 1, 2),
c as (select *, l_linenumber % 3 + 1 as span, coalesce(sum(l_linenumber % 3 + 1) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) as at_col from l)
select l_orderkey, 0 as "row", (at_col + s)::int as col, p::varchar as text, s = 0 as anchor from c, range(0, 3) r(s) where s < span"""),
    "row_signatures": (row_signatures, "select l_orderkey, l_returnflag || '|' || l_linestatus || '|' || (l_discount > 0.05)::varchar as signature, count(*) as n from lineitem group by 1, 2 having count(*) > 1"),
    "layout_shift": (layout_shift, """with l as (select l_orderkey, l_linenumber, max(l_suppkey) as value from lineitem group by 1, 2), u as (select *, count(*) over (partition by l_orderkey, value) as n from l)
select l_orderkey, value, l_linenumber as original_col, l_linenumber + 1 as compare_col from u where n = 1 and l_orderkey % 4 = 0"""),
    "cell_change_groups": (cell_change_groups, "with c as (select distinct l_orderkey, l_linenumber from lineitem where l_discount > 0.07) select l_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber) as cells, count(*) as n from c group by 1"),
    "summary_rows": (summary_rows, """with l as (select l_orderkey, sum(l_extendedprice::decimal(20,2)) as lines from lineitem group by 1) select case when lines > o_totalprice::decimal(20,2) then 'PASSED' when lines < o_totalprice::decimal(20,2) then 'SHORT' else 'COVERED' end as state,
  count(*) as n, sum(lines)::double as lines from orders join l on o_orderkey = l_orderkey group by 1"""),
    "cover_fields": (cover_fields, """select c_custkey, 'name' as label, 'DELETE' as status, c_name as before, null as after from customer where c_custkey % 9 = 0 union all select c_custkey, 'nation', 'DELETE', c_nationkey::varchar, null from customer where c_custkey % 9 = 0
union all select c_custkey, 'segment', case when c_custkey % 9 = 0 then 'DELETE' else 'MODIFY' end, c_mktsegment, case when c_custkey % 9 <> 0 then 'NONE' end from customer where c_custkey % 9 = 0 or c_custkey % 2 = 1"""),
    "event_snapshot": (event_snapshot, """with s as (select user_id, event_id, case when value >= 50 then 'compare' else 'original' end as side from events), n as (select *, case when lag(side) over (partition by user_id order by event_id) <> side then 1 else 0 end as new from s),
g as (select *, sum(new) over (partition by user_id order by event_id) as g from n)
select user_id, min(event_id) as first, case when side = 'compare' then 'ADD' else 'DELETE' end as direction, count(*) as members, 'E-' || sha256('{"k0":' || user_id || ',"k1":' || min(event_id) || '}')[1:24] as id from g group by user_id, g, side"""),
    "review_projection": (review_projection, """with s as (select user_id, case when value > 70 then 'CONFIRMED' when value < 5 then 'IGNORED' else 'PENDING' end as s from events) select user_id, case when count(distinct s) > 1 then 'NEEDS_REVIEW' else min(s) end as status from s group by 1"""),
    "glyph_regions": (glyph_regions, """with g as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as c, p.p_brand from lineitem join part p on p_partkey = l_partkey), r as (select p_brand, p_partkey as region, p_size as lo from part),
o as (select region, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, c order by lo, region) as n from g join r on g.p_brand = r.p_brand and c >= lo and c < lo + 8) select region, count(*) as glyphs from o where n = 1 group by 1"""),
    "conservation_check": (conservation_check, "select 0::bigint as lost, 0::bigint as made"),
    "baseline_lines": (baseline_lines, """with b as (select p_brand, p_partkey, p_size * 3.0::double as lo, p_size * 3.0::double + p_partkey % 4 as hi from part), n as (select *, case when lo - max(hi) over (partition by p_brand order by lo, hi, p_partkey rows between unbounded preceding and 1 preceding) <= 0.5 then 0 else 1 end as new from b),
g as (select *, sum(new) over (partition by p_brand order by lo, hi, p_partkey rows unbounded preceding) - 1 as line from n) select p_brand, line::bigint as line, count(*) as boxes, min(lo) as lo, max(hi) as hi from g group by 1, line"""),
    "direction_decision": (direction_decision, """with s as (select l_partkey, l_linenumber % 4 * 90 as angle, round_even(avg(l_discount), 6) as score, count(*) as valid from lineitem group by 1, 2),
r as (select l_partkey, sum(valid) as valid, max(score) filter (where angle = 0) as zero, max(score) as best, list(angle order by score desc, angle)[1] as best_angle, list(score order by score desc, angle)[2] as next from s group by 1)
select l_partkey, case when valid < 5 then 0 when zero >= 0.09 then 0 when best - coalesce(next, 0) >= 0.02 then best_angle else 0 end::bigint as angle, case when valid < 5 then 'TOO_FEW' when zero >= 0.09 then 'STRAIGHT' when best - coalesce(next, 0) >= 0.02 then 'CLEAR_LEAD' else 'UNDECIDED' end as reason from r"""),
    "code_ambiguity": (code_ambiguity, """with c as (select n_nationkey, upper(md5(n_name)[1:18]) as c from nation)
select n_nationkey, case n_nationkey % 3 when 0 then c[5:5] = '0' when 1 then length(c) - length(replace(replace(c, '0', ''), '5', '')) = 1 else false end as ambiguous from c"""),
    "party_spans": (party_spans, """with l as (select conv_id, turn, max(case when role = 'user' then turn end) over w as u, max(case when role = 'system' then turn end) over w as s from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, case when u > coalesce(s, -1) then u end as party_turn from l"""),
    "recognition_disagreement": (recognition_disagreement, "select l_partkey, case when count(distinct l_returnflag) > 1 then 'NEEDS_REVIEW' else 'STABLE' end as status from lineitem group by 1"),
    "valid_boxes": (valid_boxes, "select p_partkey from part where p_partkey % 5 - 1 > 0 and p_partkey % 7 > 0"),
    "table_stitch": (table_stitch, """with p as (select o_custkey, o_orderstatus as h, row_number() over (partition by o_custkey order by o_orderkey) as page from orders), n as (select *, case when h = lag(h) over (partition by o_custkey order by page) then 0 else 1 end as new from p),
g as (select *, sum(new) over (partition by o_custkey order by page) as table_group from n) select o_custkey, table_group::bigint as table_group, min(page) as first_page, count(*) as pages from g group by 1, 2"""),
    "event_session_windows": (event_session_windows, """with n as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hours then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as g from n)
select user_id, min(event_id) as first, count(*) as n from g group by user_id, g"""),
}
