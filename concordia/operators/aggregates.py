"""Counting, rollups, quality summaries and duplicate removal by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each change status counts as; MATCH counts as nothing.
COUNTED_AS = {"ADD": "insert", "INSERT": "insert", "DELETE": "delete", "MODIFY": "change", "CHANGE": "change"}


def count_changes(items: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """insert, delete, change and total per key; an unknown status fails the query."""
    known = F.create_map(*[F.lit(x) for kv in COUNTED_AS.items() for x in kv])
    kind = F.when(F.col(status) == "MATCH", None).otherwise(F.coalesce(F.element_at(known, F.col(status)), F.raise_error(F.concat(F.lit("unsupported change status: "), F.col(status)))))
    rows = items.withColumn("_kind", kind)
    of = lambda name: F.count_if(F.col("_kind") == name).alias(name)
    return rows.groupBy(*keys).agg(of("insert"), of("delete"), of("change"), F.count("_kind").alias("total"))


def ordered_means(rows: DataFrame, keys: list[str], order: list[str], means: dict[str, str], *more: Column) -> DataFrame:
    """Per key the mean of columns under new names, and further aggregates. Numbers are added one after the other in
    the given order, which must be unique: a sum of floating-point numbers changes in its last digit with
    their order, and with it a mean that lies on a limit. Nulls are passed over; a key without numbers has no mean."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({f"_sum_{name}": F.sum(column).over(window) for name, column in means.items()})
    last = F.struct(*order)
    mean = lambda name, column: (F.max_by(f"_sum_{name}", last) / F.count(column)).alias(name)
    return sums.groupBy(*keys).agg(*[mean(name, column) for name, column in means.items()], *more)


def winner(df: DataFrame, keys: list[str], order: list[Column], merge: dict[str, str]) -> DataFrame:
    """The first row of each key in an order that ends in a unique column; ``merge`` collects the
    sorted distinct values of a column over the key under a new name."""
    everyone = Window.partitionBy(*keys)
    rows = df.withColumn("_rank", F.row_number().over(everyone.orderBy(*order)))
    for name, source in merge.items():
        rows = rows.withColumn(name, F.array_sort(F.collect_set(source).over(everyone)))
    return rows.where("_rank = 1").drop("_rank")


def informative(column: str) -> list[Column]:
    """The longest non-blank value, of equally long ones the last by text, and whether values conflict."""
    value = F.when(F.trim(column) != "", F.col(column))
    best = F.max(F.when(value.isNotNull(), F.struct(F.length(F.trim(value)).alias("n"), value.alias("v"))))
    return [best["v"].alias(column), (F.count_distinct(value) > 1).alias(f"{column}_conflict")]


#: Ids of one box that stand together where boxes are compared.
TOGETHER = 256


def overlap_pairs(boxes: DataFrame, keys: list[str], id_col: str, least: float, cell: float) -> DataFrame:
    """(left, right): boxes of a key whose common area is at least ``least`` of the smaller one's.

    Boxes are joined where they share a grid cell of size ``cell``, not all with all; a pair counts in
    the one cell that holds the corner of its common area. Equal boxes are compared once and then stand for
    all their ids, at most about ``TOGETHER`` to a row, so no box is too common for a task.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    corners = ["x0", "y0", "x1", "y1"]
    share = F.pmod(F.xxhash64(id_col), F.ceil(F.count("*").over(Window.partitionBy(*keys, *corners)) / TOGETHER))
    alike = boxes.where(F.col(id_col).isNotNull()).select(*keys, *corners, id_col, share.alias("_share"))
    alike = alike.groupBy(*keys, *corners, "_share").agg(F.collect_list(id_col).alias("_ids"))
    rows = alike.withColumn("_cx", cells("x0", "x1")).withColumn("_cy", cells("y0", "y1"))
    names = [*corners, "_share", "_ids"]
    a = rows.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"l_{c}") for c in names])
    b = rows.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"r_{c}") for c in names])
    x, y = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    width, height = F.least("l_x1", "r_x1") - x, F.least("l_y1", "r_y1") - y
    area = lambda s: (F.col(f"{s}_x1") - F.col(f"{s}_x0")) * (F.col(f"{s}_y1") - F.col(f"{s}_y0"))
    place = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in names[:-1]])
    joined = a.join(b, [*keys, "_cx", "_cy"]).where((width > 0) & (height > 0) & (width * height >= least * F.least(area("l"), area("r"))))
    joined = joined.where((F.col("_cx") == F.floor(x / cell)) & (F.col("_cy") == F.floor(y / cell)) & (place("l") <= place("r")))
    pairs = joined.select((place("l") == place("r")).alias("_same"), F.explode("l__ids").alias("_l"), "r__ids").select("_same", "_l", F.explode("r__ids").alias("_r"))
    pairs = pairs.where(F.when(F.col("_same"), F.col("_l") < F.col("_r")).otherwise(F.col("_l") != F.col("_r")))
    return pairs.select(F.least("_l", "_r").alias("left"), F.greatest("_l", "_r").alias("right"))
