"""Documents as ordered lines: units, noise filters, segmentation, shared lines between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.normalize import is_page_number


def line_units(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): non-blank lines, numbered from 0 as they stand in the text."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line")).where("line <> ''")


def without_page_numbers(lines: DataFrame) -> DataFrame:
    return lines.where(~is_page_number(F.col("line")))


def first_with(lines: DataFrame) -> DataFrame:
    """(left, right): each document with the smallest other that has the same line. ``lines``: doc_id, line."""
    first = lines.groupBy("line").agg(F.min("doc_id").alias("left"), F.max("doc_id").alias("_last")).where("left < _last")
    return lines.join(first, "line").where(F.col("doc_id") > F.col("left")).select("left", F.col("doc_id").alias("right")).distinct()


def version_pairs(lines: DataFrame, p: int = 1, q: int = 2) -> DataFrame:
    """(original_id, compare_id, shared): each document with the earlier one (smaller doc_id) whose distinct lines are
    most alike, if the Jaccard share of the lines is p/q or more; of equal ones the smallest.

    No line is too frequent to count. Documents with the same lines are one class, and only the smallest of each
    class is searched: of its lines in order of frequency the first n - ceil(np/q) + 1 hold one of every
    partner's first ones, so a line that many share makes candidates only of documents that have little else.
    """
    distinct = lines.select("doc_id", F.md5("line").alias("line")).distinct()
    sets = distinct.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("line")), "")).alias("set"))
    classes = sets.groupBy("set").agg(F.min("doc_id").alias("rep"))
    copies = sets.join(classes, "set").where("doc_id > rep").select(F.col("rep").alias("original_id"), F.col("doc_id").alias("compare_id"), F.col("n").alias("shared"))
    reps = distinct.join(sets.join(classes, "set").where("doc_id = rep").select("doc_id", "n"), "doc_id")
    frequency = reps.groupBy("line").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "line"))
    prefix = reps.join(frequency, "line").withColumn("_r", place).where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * p / q) + 1).where("df > 1")
    side = lambda df, doc, n: df.select(F.col("doc_id").alias(doc), F.col("n").alias(n), "line")
    close = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)
    candidates = side(prefix, "a", "n_a").join(side(prefix, "b", "n_b"), "line").where(close).select("a", "n_a", "b", "n_b").distinct()
    one, two = reps.select(F.col("doc_id").alias("a"), "line"), reps.select(F.col("doc_id").alias("b"), "line")
    common = candidates.join(one, "a").join(two, ["b", "line"]).groupBy("a", "n_a", "b", "n_b").agg(F.count("*").alias("shared"))
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    best = common.where(F.col("shared") * q >= union * p).groupBy("b").agg(F.max_by(F.struct(F.col("a").alias("original_id"), "shared"), F.struct(F.col("shared") / union, -F.col("a"))).alias("_m"))
    return best.select("_m.original_id", F.col("b").alias("compare_id"), "_m.shared").unionByName(copies)


def line_changes(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(original_id, compare_id, status, n): distinct lines of a pair as MATCH, DELETE or ADD."""
    distinct = lines.select("doc_id", "line").distinct()
    left = pairs.select("original_id", "compare_id").join(distinct.withColumnRenamed("doc_id", "original_id"), "original_id").withColumn("in_original", F.lit(1))
    right = pairs.select("original_id", "compare_id").join(distinct.withColumnRenamed("doc_id", "compare_id"), "compare_id").withColumn("in_compare", F.lit(1))
    both = left.join(right, ["original_id", "compare_id", "line"], "full_outer")
    status = F.when(F.col("in_compare").isNull(), "DELETE").when(F.col("in_original").isNull(), "ADD").otherwise("MATCH")
    return both.groupBy("original_id", "compare_id", status.alias("status")).agg(F.count("*").alias("n"))


def repeated_overlays(lines: DataFrame, group: str, min_docs: int, min_share: float, lengths: tuple[int, int]) -> DataFrame:
    """(group, line, docs): short lines that stand in many documents of a group, and in a share of all."""
    short = lines.where(F.length("line").between(*lengths)).select(group, "doc_id", "line").distinct()
    size = lines.groupBy(group).agg(F.countDistinct("doc_id").alias("group_docs"))
    found = short.groupBy(group, "line").agg(F.count("*").alias("docs")).join(size, group)
    return found.where((F.col("docs") >= min_docs) & (F.col("docs") >= min_share * F.col("group_docs"))).select(group, "line", "docs")


def first_reason(*rules: tuple[str, Column], default: str) -> Column:
    """The name of the first rule that holds."""
    found = F.lit(default)
    for name, rule in reversed(rules):
        found = F.when(rule, name).otherwise(found)
    return found


def segments(units: DataFrame, keys: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """Folds units into clauses: a unit that starts one, and those after it up to the next.

    (keys, clause_seq, first, units, text): clause 0 holds what comes before the first start.
    """
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = units.withColumn("clause_seq", F.sum(F.when(starts, 1).otherwise(0)).over(window))
    rows = numbered.groupBy(*keys, "clause_seq").agg(F.min(order).alias("first"), F.count("*").alias("units"), F.array_sort(F.collect_list(F.struct(order, text))).alias("_rows"))
    return rows.select(*keys, "clause_seq", "first", "units", F.array_join(F.transform("_rows", lambda r: r[text]), "\n").alias("text"))


def islands(df: DataFrame, keys: list[str], order: Column, least: int) -> DataFrame:
    """(keys, first, last, n): runs of consecutive values of ``order``, ``least`` long or longer."""
    rows = df.select(*keys, order.cast("long").alias("_v")).distinct()
    run = F.col("_v") - F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))
    found = rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("_v").alias("first"), F.max("_v").alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("_run")


def last_per_level(df: DataFrame, keys: list[str], order: str, level: Column, label: Column, levels: int) -> DataFrame:
    """The heading stack: for each row the last label of each level, a level being emptied by any
    higher heading after it. Adds path, the labels joined by '/'."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = []
    for i in range(1, levels + 1):
        own = F.last(F.when(level == i, F.struct(F.col(order).alias("at"), label.alias("label"))), True).over(window)
        above = F.last(F.when(level < i, F.col(order)), True).over(window)
        columns.append(F.when(own.isNotNull() & (above.isNull() | (own["at"] > above)), own["label"]))
    return df.withColumn("path", F.concat_ws("/", *columns))


def carry_forward(df: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value up to each row."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, True).over(window))
