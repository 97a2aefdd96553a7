"""Evidence: boxes, regions, readings and fields, and what they decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that are read for one another.
LOOK_ALIKE = ["O0", "0O", "I1", "1I", "L1", "1L", "S5", "5S"]


def windows_of(page: Column, size: int, overlap: int) -> Column:
    """Numbers (from 0) of the windows of ``size`` pages, overlapping by ``overlap``, that hold a page from 1 on."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((page - size) / step))
    last = F.greatest(first, F.floor((page - 1) / step))
    return F.sequence(first.cast("long"), last.cast("long"))


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite(x0) & finite(y0) & finite(x1) & finite(y1) & (x1 > x0) & (y1 > y0)


def word_boxes(df: DataFrame, id_col: str, text: str, x0: float, x1: float) -> DataFrame:
    """(id, start, end, x0, x1): runs of characters between blanks, the line's width split evenly."""
    chars = df.select(id_col, F.length(text).alias("_n"), F.posexplode(F.split(text, "")).alias("_p", "_c")).where("_c <> ' '")
    run = F.col("_p") - F.row_number().over(Window.partitionBy(id_col).orderBy("_p"))
    at = lambda p: F.bround(F.lit(x0) + (x1 - x0) * p / F.first("_n"), 4)
    rows = chars.withColumn("_run", run).groupBy(id_col, "_run")
    return rows.agg(F.min("_p").cast("long").alias("start"), (F.max("_p") + 1).cast("long").alias("end"), at(F.min("_p")).alias("x0"), at(F.max("_p") + 1).alias("x1")).drop("_run")


def counterparts(regions: DataFrame, blocks: DataFrame, region: str, block: str, reach: float, margin: float) -> DataFrame:
    """(region, block, score): the block nearest to each region within ``reach`` on both axes, if it leads
    the next by ``margin``. Places meet in grid cells of that size, never all with all: the first block of a place
    stands for all on it, and regions on one place are compared once."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    a = regions.select("x", "y").distinct().withColumn("_cx", around("x")).withColumn("_cy", around("y"))
    b = blocks.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min(F.struct(block))[block].alias(block), (F.count("*") > 1).alias("_more"))
    b = b.withColumn("_cx", cell("_x")).withColumn("_cy", cell("_y"))
    dx, dy = F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y"))
    near = a.join(b, ["_cx", "_cy"]).where((dx <= reach) & (dy <= reach)).select("x", "y", block, "_more", F.bround(1 - (dx + dy) / (2 * reach), 6).alias("score"))
    first = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("score").desc(), block)
    near = near.withColumn("_r", F.row_number().over(first("x", "y"))).where("_r <= 2").drop("_r")
    rows = regions.select(region, "x", "y").join(near, ["x", "y"]).select(region, block, "score", "_more")
    # The next of a place's first block is its second one.
    following = F.when(F.col("_more"), F.col("score")).otherwise(F.lead("score").over(first(region)))
    rows = rows.withColumn("_r", F.row_number().over(first(region))).withColumn("_next", following)
    return rows.where((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))).drop("_r", "_next", "_more")


def consensus(readings: DataFrame, keys: list[str], side: str, reading: str) -> DataFrame:
    """EQUIVALENT or DIFFERENT where each side's readings agree, CONFLICT where they don't, UNKNOWN without one."""
    of = lambda name: F.array_sort(F.collect_set(F.when(F.col(side) == name, F.col(reading))))
    rows = readings.groupBy(*keys).agg(of("original").alias("_a"), of("compare").alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    found = F.when((F.size(a) == 0) | (F.size(b) == 0), "UNKNOWN").when((F.size(a) > 1) | (F.size(b) > 1), "CONFLICT").when(a == b, "EQUIVALENT").otherwise("DIFFERENT")
    return rows.select(*keys, found.alias("consensus"))


def equivalence(a: Column, b: Column) -> Column:
    """Why two texts count as the same, by ordered rules; a percent or per-mille sign protects a difference."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    signs = lambda c: F.regexp_replace(c, "[^%‰]", "")
    fold = lambda c: F.regexp_replace(bare(c), r"""[，。；：、”“‘’（）()\[\]【】《》,.!?:;"'·•]""", "")
    return F.when(a == b, "IDENTICAL").when(signs(a) != signs(b), "PROTECTED_SIGN").when(bare(a) == bare(b), "WHITE_SPACE").when(F.lower(fold(a)) == F.lower(fold(b)), "PUNCTUATION").otherwise("DIFFERENT")


def label_fields(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, label, value): lines of the form label: value, labels lower-cased, the first of a label."""
    lines = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("_n", "_l"))
    form = r"^\s*([^:：]+?)\s*[:：]\s*(.*?)\s*$"
    rows = lines.where(F.col("_l").rlike(form)).select(id_col, F.lower(F.regexp_extract("_l", form, 1)).alias("label"), F.struct("_n", F.regexp_extract("_l", form, 2).alias("v")).alias("_v"))
    return rows.groupBy(id_col, "label").agg(F.min("_v")["v"].alias("value"))


def direction(scores: DataFrame, key: str, least: int = 5, straight: float = 0.09, lead: float = 0.02) -> DataFrame:
    """(key, angle, reason) from (key, angle, score, valid): 0 if too little was read or it reads well
    straight, else the best angle if it leads by a margin."""
    ranked = F.sort_array(F.collect_list(F.struct("score", (-F.col("angle")).alias("_neg"))), asc=False)
    rows = scores.groupBy(key).agg(F.sum("valid").alias("_n"), F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("_zero"), ranked.alias("_r"))
    best, second = F.get("_r", F.lit(0)), F.coalesce(F.get("_r", F.lit(1))["score"], F.lit(0.0))
    reason = F.when(F.col("_n") < least, "TOO_FEW").when(F.col("_zero") >= straight, "STRAIGHT").when(best["score"] - second >= lead, "CLEAR_LEAD").otherwise("UNDECIDED")
    return rows.select(key, F.when(reason == "CLEAR_LEAD", -best["_neg"]).otherwise(0).cast("long").alias("angle"), reason.alias("reason"))


def ambiguous_codes(a: Column, b: Column) -> Column:
    """Whether two codes of one length differ in exactly one place, by characters that look alike."""
    differ = F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    return (F.length(a) == F.length(b)) & (F.size(differ) == 1) & F.coalesce(F.get(differ, F.lit(0)).isin(*LOOK_ALIKE), F.lit(False))
