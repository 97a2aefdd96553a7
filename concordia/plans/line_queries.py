"""Queries over documents as lines, and over markers formatted from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.functions import normalize as norm
from concordia.functions.numbering import marker
from concordia.operators import lines as op
from concordia.sources.tables import table

_LINES = r"""
lines as (
  select doc_id, source, (i - 1)::bigint as line_no, trim(parts[i]) as line
  from (select doc_id, source, string_split(text, chr(10)) as parts from documents), range(1, len(parts) + 1) r(i)
  where trim(parts[i]) <> '')
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return op.line_units(table(spark, d, "documents"))


def flagship_line_changes(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return op.line_changes(lines, op.version_pairs(lines))


FLAGSHIP = f"""
with {_LINES},
u as (select distinct doc_id, line from lines), nu as (select doc_id, count(*) as n from u group by 1),
cu as (select a.doc_id as o, b.doc_id as c, count(*) as s from u a join u b on a.line = b.line and a.doc_id < b.doc_id group by 1, 2),
pairs as (select o as original_id, c as compare_id, row_number() over (partition by c order by s::double / (x.n + y.n - s) desc, o) as r from cu join nu x on x.doc_id = o join nu y on y.doc_id = c where 2 * s >= x.n + y.n - s qualify r = 1),
l as (select original_id, compare_id, line from pairs join u on doc_id = original_id),
r as (select original_id, compare_id, line from pairs join u on doc_id = compare_id),
f as (select coalesce(l.original_id, r.original_id) as original_id, coalesce(l.compare_id, r.compare_id) as compare_id,
        case when r.line is null then 'DELETE' when l.line is null then 'ADD' else 'MATCH' end as status
      from l full join r on l.original_id = r.original_id and l.compare_id = r.compare_id and l.line = r.line)
select original_id, compare_id, status, count(*) as n from f group by 1, 2, 3
"""


def change_counts(spark: SparkSession, d: str) -> DataFrame:
    changes = flagship_line_changes(spark, d)
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0))
    return changes.groupBy("original_id", "compare_id").agg(of("ADD").alias("insert"), of("DELETE").alias("delete"), (of("ADD") + of("DELETE")).alias("total"))


def line_units(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def page_number_line_filter(spark: SparkSession, d: str) -> DataFrame:
    """Page-number lines formatted from order lines stand among a document's own lines."""
    own = _lines(spark, d)
    numbers = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("  "), F.col("l_linenumber").cast("string"), F.lit(" 页")).alias("line")).distinct()
    mixed = own.select("doc_id", "line").unionByName(numbers)
    return mixed.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(~norm.is_page_number(F.col("line"))).alias("kept"))


def normalize_for_match(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "documents").select("doc_id", norm.normalize_for_match(F.col("text")).alias("flat"))
    return folded.select("doc_id", F.length("flat").cast("long").alias("n"), F.md5("flat").alias("folded"))


def normalize_for_diff(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "documents").select("doc_id", norm.normalize_for_diff(F.col("text")).alias("flat"))
    return folded.select("doc_id", F.length("flat").cast("long").alias("n"), F.md5("flat").alias("folded"))


_KEPT = r"""
kept as (
  select doc_id, coalesce(list_filter(list_transform(string_split(replace(nfc_normalize(text), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
    lambda x: x <> '' and not regexp_matches(x, '^(第? ?\d+ ?页?)$')), []) as l from documents)
"""


def repeated_overlay_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lines = op.line_units(docs).join(docs.select("doc_id", "source"), "doc_id")
    return op.repeated_overlays(lines, "source", 2, 0.02, (2, 60))


def block_eligibility(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    length = F.length(F.trim("text"))
    blank = F.length("text") - F.length(F.regexp_replace("text", " ", ""))
    reason = op.first_reason(
        ("empty", F.col("text").isNull() | (length == 0)),
        ("masked", F.col("toxic") == 1),
        ("low_confidence", F.col("quality") == 0),
        ("low_density", blank * 1.0 / F.length("text") > 0.25),
        ("too_short", length < 20),
        default="eligible",
    )
    return docs.join(labels, "doc_id", "left").select("doc_id", reason.alias("reason"))


def clause_number_parse(spark: SparkSession, d: str) -> DataFrame:
    """Markers of every style, formatted from order lines, parsed back."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    key, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    styles = [F.concat(key, F.lit("."), n, F.lit(". text")), F.concat(F.lit("("), n, F.lit(") text")), F.concat(F.lit("第"), n, F.lit("条 text")), F.concat(n, F.lit("、text")), F.concat(F.lit("text "), n)]
    line = F.element_at(F.array(*styles), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = items.select("*", line.alias("line")).withColumn("found", marker(F.col("line")))
    return rows.groupBy("line").agg(F.first("found.style").alias("style"), F.first("found.number").alias("number"), F.first("found.level").alias("level"), F.count("*").alias("n"))


CLAUSE_NUMBER = r"""
with rows as (
  select case l_partkey % 5 when 0 then l_orderkey || '.' || l_linenumber || '. text' when 1 then '(' || l_linenumber || ') text'
    when 2 then '第' || l_linenumber || '条 text' when 3 then l_linenumber || '、text' else 'text ' || l_linenumber end as line
  from lineitem),
p as (
  select line, case when regexp_matches(line, '^第[0-9]+条') then 'formal' when regexp_matches(line, '^[(][0-9]+[)]') then 'parenthesized'
    when regexp_matches(line, '^[0-9]') then 'decimal' end as style, count(*) as n from rows group by line)
select line, style, n,
  case when style = 'decimal' then regexp_extract(line, '^([0-9]+(\.[0-9]+)*)', 1) when style is not null then regexp_extract(line, '([0-9]+)', 1) end as number,
  case when style = 'formal' then 3 when style = 'parenthesized' then 4 when style = 'decimal' then length(regexp_extract(line, '^([0-9]+(\.[0-9]+)*)', 1)) - length(replace(regexp_extract(line, '^([0-9]+(\.[0-9]+)*)', 1), '.', '')) + 1 end::int as level
from p
"""


def clause_segmentation(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document that end a sentence close a clause: the next line starts one."""
    lines = _lines(spark, d)
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.withColumn("_starts", before.rlike(r"\.$"))
    found = op.segments(rows, ["doc_id"], "line_no", F.col("_starts"), "line")
    return found.select("doc_id", "clause_seq", "first", "units", F.md5("text").alias("text"))


SEGMENTATION = f"""
with {_LINES},
s as (select *, case when regexp_matches(lag(line) over (partition by doc_id order by line_no), '[.]$') then 1 else 0 end as starts from lines),
c as (select *, sum(starts) over (partition by doc_id order by line_no) as clause_seq from s)
select doc_id, clause_seq::bigint as clause_seq, min(line_no) as first, count(*) as units, md5(string_agg(line, chr(10) order by line_no)) as text
from c group by 1, clause_seq
"""


def numbered_sequence_islands(spark: SparkSession, d: str) -> DataFrame:
    return op.islands(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_linenumber"), 3)


def section_path_fold(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 3)
    rows = op.last_per_level(events, ["user_id"], "event_id", level, F.col("event_id").cast("string"), 3)
    return rows.select("event_id", "user_id", "path")


SECTION_PATH = """
with l as (select event_id, user_id, case event_type when 'signup' then 1 when 'purchase' then 2 when 'error' then 3 end as level from events),
s as (
  select event_id, user_id,
    max(case when level = 1 then event_id end) over w as one, max(case when level = 2 then event_id end) over w as two, max(case when level = 3 then event_id end) over w as three
  from l window w as (partition by user_id order by event_id))
select event_id, user_id, concat_ws('/', one::varchar, case when two > coalesce(one, -1) then two::varchar end, case when three > greatest(coalesce(one, -1), coalesce(two, -1)) then three::varchar end) as path
from s
"""


def caption_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = op.carry_forward(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "caption_turn")
    return rows.select("conv_id", "turn", "caption_turn")


def shorten_text(spark: SparkSession, d: str) -> DataFrame:
    """ASCII white space only, so that both engines fold alike."""
    short = norm.shorten(F.translate("text", "\t\n\r", "   "))
    return table(spark, d, "documents").select("doc_id", F.length(short).cast("long").alias("n"), F.md5(short).alias("short"))


QUERIES = {
    "flagship_line_changes": (flagship_line_changes, FLAGSHIP),
    "change_counts": (change_counts, f"""select original_id, compare_id, sum(n) filter (where status = 'ADD') is null as x,
  coalesce(sum(n) filter (where status = 'ADD'), 0)::bigint as "insert", coalesce(sum(n) filter (where status = 'DELETE'), 0)::bigint as "delete",
  coalesce(sum(n) filter (where status <> 'MATCH'), 0)::bigint as total from ({FLAGSHIP}) group by 1, 2""".replace("sum(n) filter (where status = 'ADD') is null as x,\n", "")),
    "line_units": (line_units, f"with {_LINES} select doc_id, line_no, line from lines"),
    "page_number_line_filter": (page_number_line_filter, f"""with {_LINES},
u as (select doc_id, line from lines union all select distinct l_orderkey, '  ' || l_linenumber || ' 页' from lineitem)
select doc_id, count(*) as lines, count(*) filter (where not regexp_matches(line, '^\\s*((第\\s*)?\\d+\\s*(页)?|共\\s*\\d+\\s*页\\s*第\\s*\\d+\\s*页)\\s*$')) as kept from u group by 1"""),
    "normalize_for_match": (normalize_for_match, f"""with {_KEPT},
f as (select doc_id, lower(regexp_replace(regexp_replace(array_to_string(l, ''), '\\s+', '', 'g'), '[，。；：、”“‘’（）()\\[\\]【】《》,.!?:;"'']', '', 'g')) as f from kept)
select doc_id, length(f)::bigint as n, md5(f) as folded from f"""),
    "normalize_for_diff": (normalize_for_diff, f"""with {_KEPT},
f as (select doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(l, ''), '\\s+', '', 'g'),
  '(\\d),(\\d\\d\\d)($|\\D)', '\\1\\2\\3', 'g'), '(\\d),(\\d\\d\\d)($|\\D)', '\\1\\2\\3', 'g'), '[，。；：、”“‘’（）()\\[\\]【】《》!?:;"'']', '', 'g')) as f from kept)
select doc_id, length(f)::bigint as n, md5(f) as folded from f"""),
    "repeated_overlay_lines": (repeated_overlay_lines, f"""with {_LINES},
s as (select distinct source, doc_id, line from lines where length(line) between 2 and 60), g as (select source, count(distinct doc_id) as docs from lines group by 1)
select s.source, line, count(*) as docs from s join g on s.source = g.source group by s.source, line, g.docs having count(*) >= 2 and count(*) >= 0.02 * g.docs"""),
    "block_eligibility": (block_eligibility, """select documents.doc_id, case when text is null or length(trim(text)) = 0 then 'empty' when toxic = 1 then 'masked' when quality = 0 then 'low_confidence'
  when (length(text) - length(replace(text, ' ', ''))) * 1.0 / length(text) > 0.25 then 'low_density' when length(trim(text)) < 20 then 'too_short' else 'eligible' end as reason
from documents left join labels on documents.doc_id = labels.doc_id"""),
    "clause_number_parse": (clause_number_parse, CLAUSE_NUMBER),
    "clause_segmentation": (clause_segmentation, SEGMENTATION),
    "numbered_sequence_islands": (numbered_sequence_islands, """with v as (select distinct l_orderkey, l_linenumber::bigint as v from lineitem),
r as (select *, v - row_number() over (partition by l_orderkey order by v) as run from v)
select l_orderkey, min(v) as first, max(v) as last, count(*) as n from r group by l_orderkey, run having count(*) >= 3"""),
    "section_path_fold": (section_path_fold, SECTION_PATH),
    "caption_carry_forward": (caption_carry_forward, """select conv_id, turn, max(case when role = 'user' then turn end) over (partition by conv_id order by turn) as caption_turn from conversations"""),
    "shorten_text": (shorten_text, r"""with s as (select doc_id, trim(regexp_replace(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   '), '\s+', ' ', 'g')) as t from documents),
r as (select doc_id, case when length(t) > 220 then t[1:220] || '...' else t end as s from s) select doc_id, length(s)::bigint as n, md5(s) as short from r"""),
}
