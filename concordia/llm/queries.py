"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import canonical_digest, huffman, language_id, media, mixing, ngram_join, packing, phrase_automata, secret_scan, sparse_suffix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.repeat_report(documents(spark, sf_dir))


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_digest.fingerprint_report(documents(spark, sf_dir).select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.id_report(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_report(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), 3, Fraction(90, 100))


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeated_passages(documents(spark, sf_dir))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit_on(docs, ~held_out(F.col("doc_id")))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of_kind("assign"), of_kind("access"), of_kind("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_media, op3_huffman, op4_phrase_automata, op5_canonical_digest, op6_mixing, op7_ngram_join, op8_sparse_suffix, op9_language_id, op10_secret_scan]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": OP6_SQL, "op7_ngram_join": OP7_SQL, "op4_phrase_automata": OP4_SQL, "op8_sparse_suffix": OP8_SQL}


OP6_SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, 'null')) as place
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3]::double as weight from s),
level(l, step) as (
  select (select 1.5 * sum(source_size) / sum(weight) from w)::double, 0
  union all
  select (select (1.5 * (select sum(source_size) from w) - coalesce(sum(2.0 * source_size) filter (where 2.0 * source_size < l * weight), 0))
                 / sum(weight) filter (where 2.0 * source_size >= l * weight) from w)::double, step + 1
  from level where step < 40),
l as (select max(l) as l from level),
t as (select source, source_size, least(2.0 * source_size, l * weight)::double as target from w, l),
r as (select d.*, t.source_size, t.target,
        case when t.source_size > 0 then floor(floor(target) / t.source_size) else 0 end::bigint as whole,
        coalesce(sum(size) over (partition by t.source order by place, size rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::bigint as taken
from r
"""

OP7_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (
  select doc_id, case when w is null or len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as g from w),
n as (select doc_id, len(g)::bigint as n_shingles, md5(array_to_string(list_sort(g), chr(10))) as set_id from g),
reps as (select set_id, min(doc_id) as rep from n where n_shingles > 0 group by set_id),
e as (select g.doc_id, unnest(g.g) as s from g join reps on reps.rep = g.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
pair_of(a, b) as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from pair_of union select reach.a, pair_of.b from reach join pair_of on reach.b = pair_of.a),
comp as (select rep, least(rep, coalesce(min(b), rep)) as c from reps left join reach on rep = a group by rep)
select n.doc_id, n_shingles, case when n_shingles = 0 then n.doc_id else comp.c end as component_id
from n left join reps using (set_id) left join comp on comp.rep = reps.rep
"""

OP4_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (
  select doc_id, unnest(range(1, len(w) - 11)) as p, md5(array_to_string(w[unnest(range(1, len(w) - 11)) : unnest(range(13, len(w) + 1))], ' ')) as h
  from w where len(w) >= 13),
first as (select h, min(doc_id) as owner from win group by h),
hit as (select distinct doc_id, p + o as place from win join first using (h), range(0, 13) r(o) where owner < doc_id),
gone as (select doc_id, list(place) as gone from hit group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: gone is null or not list_contains(gone, x[2])), lambda x: x[1]), ' ')) as kept_sha256
from w left join gone on w.doc_id = gone.doc_id
"""

OP8_SQL = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (
  select doc_id, unnest(range(1, len(w) - 48)) as p, md5(array_to_string(w[unnest(range(1, len(w) - 48)) : unnest(range(50, len(w) + 1))], ' ')) as h
  from w where len(w) >= 50),
first as (select h, min(doc_id) as owner from win group by h),
hit as (select doc_id, p, owner from win join first using (h) where owner < doc_id),
new as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as opens from hit),
span as (select *, sum(opens) over (partition by doc_id order by p) as span from new)
select doc_id, (min(p) - 1)::bigint as start, (max(p) - min(p) + 50)::bigint as n_words, min(owner) as first_doc_id from span group by doc_id, span
"""
