"""Canonical exact digests: Unicode folding, then a wide xxhash, then a comparison of bytes.

Only DataFrame expressions run here. Spark has no normalisation function of its own, so NFKC
comes from ICU, which Spark ships and loads in every JVM, through the SQL function ``reflect``.

* null text: counts as empty, so it shares the empty text's fingerprint
* repeated rows, ties: equal canonical texts share one fingerprint whatever their number
* empty table: no rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.storage import range_expression, shuffle_partitions

#: White space after NFKC (no-break and wide spaces have become U+0020 by then).
_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{1680}\x{2028}\x{2029}]+"


def canonical_text(text: Column) -> Column:
    """NFKC, upper then lower case (so that sharp s and final sigma fold), single spaces, no edges."""
    whole = F.coalesce(text, F.lit(""))
    folded = F.lower(F.upper(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), whole, F.lit(True))))
    return F.trim(F.regexp_replace(folded, _SPACE, " "))


def wide_digest(canonical: Column) -> Column:
    """128 bits as 32 hex digits: two xxhash64 runs that differ in their first block."""
    half = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canonical), F.xxhash64(F.lit("concordia"), canonical))]
    return F.concat(*half)


def fingerprint(text: Column) -> Column:
    return wide_digest(canonical_text(text))


def likeness(a: Column, b: Column) -> Column:
    """An exact digest knows only equal (1.0) and different (0.0)."""
    return F.when(a == b, 1.0).otherwise(0.0)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of canonically equal texts: (fingerprint, canonical_sha256, bucket_member, group_id, group_size).

    Rows meet by digest; inside a bucket of two or more the canonical bytes themselves are
    compared by grouping on them, so two texts that share a digest by accident stay apart
    (bucket_member 0, 1, ...). The aggregation combines before its shuffle, so a text held by
    a third of the rows costs one row for each map task. group_id is the smallest id. Join a
    table of ids to this by (fingerprint, canonical_sha256): no text moves a second time.
    """
    rows = docs.select(F.col(id_col).alias("id"), canonical_text(F.col(text_col)).alias("canonical"))
    rows = rows.select("id", "canonical", wide_digest(F.col("canonical")).alias("fingerprint"))
    classes = rows.groupBy("fingerprint", "canonical").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    classes = classes.withColumn("canonical_sha256", F.sha2("canonical", 256)).drop("canonical")
    order = Window.partitionBy("fingerprint").orderBy("canonical_sha256")
    return classes.withColumn("bucket_member", F.row_number().over(order) - 1)


def with_next(docs: DataFrame, id_col: str, value: str, spread: int = 4) -> DataFrame:
    """Adds ``next_<value>``: the value of the row with the next larger id; the first row's for the last.

    ``docs`` holds the two columns alone. Ids are cut into ranges of about equal counts at their
    percentiles; each range is sorted by itself and only its first row travels to the range
    before. No window spans the table. Rows that repeat an id follow one another in order of
    their value; rows whose id is null come first.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    n = partitions * spread
    cuts, top = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 100 * n), F.max(id_col)).head()
    cuts = sorted(c for c in set(cuts or []) if c < top)
    ranged = docs.withColumn("range", F.expr(range_expression(id_col, cuts))).repartition(partitions, "range")
    order = Window.partitionBy("range").orderBy(id_col, value)
    nexts = ranged.select("*", F.lead(value).over(order).alias("_next"), F.lag(F.lit(1)).over(order).alias("_before"), F.lead(F.lit(1)).over(order).alias("_after"))
    # Each range holds the id at its upper cut, so none is empty and the order of ranges is known.
    # Keys that can't be null keep both branches on one exchange (a pushed null filter would split it).
    heads = nexts.where("_before is null").select(F.expr(f"IF(range = 0, {len(cuts)}, range - 1)").alias("range"), F.col(value).alias("_head"))
    tails = nexts.where("_after is null").join(heads, "range").select(id_col, value, F.col("_head").alias(f"next_{value}"))
    return nexts.where("_after is not null").select(id_col, value, F.col("_next").alias(f"next_{value}")).unionByName(tails)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness, and the exact classes.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all)
    of the next document's.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, "doc_id", "text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 4)))"))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.when(quarter > 0, edited).otherwise(F.col("text")).alias("edited"),
        canonical_text(F.col("text")).alias("canonical"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    ).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        wide_digest(F.col("canonical")).alias("fingerprint"),
        F.sha2("canonical", 256).alias("canonical_sha256"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    rows = rows.join(exact_groups(texts), ["fingerprint", "canonical_sha256"])
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "group_id",
        "group_size",
        "bucket_member",
    )
