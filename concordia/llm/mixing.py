"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Only DataFrame expressions run here.

* null text: size 0; null source: a source of its own, the last in order
* a source whose documents are all empty: target 0, nothing taken
* ties of the seeded order (rows that repeat a doc_id): broken by size; rows that agree in both
  are alike, and which of them takes the last words does not change the result as a set
* empty table: no rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.llm.storage import materialize

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: Cells that the seeded order of a source is summed in before single documents are looked at.
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(id_col: str, seed: str = SEED) -> Column:
    """A seeded place in the order of a source: 32 hex digits, the same on every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def water_fill(sources: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Weights repeat along the sources by code point, null last. Targets share ``share`` times all
    sizes by weight; a target stops at ``cap`` times its source's size and the excess goes to the
    rest by weight until none is above. The fixed point is found in one pass: in order of
    cap*size/weight, sources are clamped as long as the level that the rest would reach lies
    above theirs. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("_level", F.lit(cap) * F.col("source_size") / F.col("weight"))
    everything = Window.orderBy("_level", F.col("source").isNull(), "source")
    upto = everything.rowsBetween(Window.unboundedPreceding, -1)
    beyond = everything.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    rows = rows.select(
        "*",
        (F.lit(share) * total).alias("_budget"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(upto), F.lit(0.0)).alias("_clamped"),
        F.sum("weight").over(beyond).alias("_weight_left"),
        F.row_number().over(everything).alias("_at"),
    )
    # Level that this source and all above it reach if all below are clamped.
    rows = rows.withColumn("_reach", (F.col("_budget") - F.col("_clamped")) / F.col("_weight_left"))
    free = F.min(F.when(F.col("_reach") < F.col("_level"), F.struct("_level", "_at", "_reach"))).over(Window.partitionBy())
    rows = rows.withColumn("_free", free)
    target = F.when(F.col("_free").isNull() | (F.col("_at") < F.col("_free._at")), F.lit(cap) * F.col("source_size")).otherwise(F.col("weight") * F.col("_free._reach"))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken.

    A source takes each document whole floor(target/source_size) times, then documents in seeded
    order once more until the target is met; the last of those gives only its first words. So
    a source's taken words equal its target rounded down, and no document exceeds ceil(cap) times
    its size. No window spans a source: the seeded order is first summed in ``CELLS`` cells of
    equal hash ranges, and only the cell in which a target falls is put in order.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded("doc_id", seed).alias("_place"))
    rows = rows.withColumn("_cell", F.conv(F.substring("_place", 1, 3), 16, 10).cast("int") * (CELLS // 4096))
    rows = materialize(rows, "mix-sizes")
    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_cell_size"))
    cells = materialize(cells, "mix-cells")
    targets = water_fill(cells.groupBy("source").agg(F.sum("_cell_size").alias("source_size")), list(weights), share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_more", (F.floor("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cell_from", F.coalesce(F.sum("_cell_size").over(before), F.lit(0)))
    plan = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    room = F.col("_more") - F.col("_cell_from")
    plan = plan.withColumn("_kind", F.when(room >= F.col("_cell_size"), 2).when(room > 0, 1).otherwise(0))
    placed = rows.join(plan.withColumnRenamed("source", "_s").withColumnRenamed("_cell", "_c"), (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_cell") == F.col("_c")))
    keep = ["doc_id", "source", "size", "source_size", "target"]
    plain = placed.where("_kind <> 1").select(*keep, (F.col("_whole") * F.col("size") + F.when(F.col("_kind") == 2, F.col("size")).otherwise(0)).cast("long").alias("taken"))
    inside = Window.partitionBy("source", "_cell").orderBy("_place", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("_kind = 1").withColumn("_left", F.col("_more") - F.col("_cell_from") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.select(*keep, (F.col("_whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))).cast("long").alias("taken"))
    return plain.unionByName(cut)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, n_chars following the text.

    A row stands once for each whole time it is taken; the rest, if any, is a row with its first
    words, joined by single blanks. Rows that agree in doc_id, source and size share their takes in
    any order. All columns of ``docs`` stay.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    alike = Window.partitionBy("_key", "source", "_size")
    rows = docs.withColumn("_key", key).withColumn("_size", n_words(F.col("text"))).where("_size > 0").repartition("_key")
    rows = rows.withColumn("_n", F.row_number().over(alike.orderBy("_key")))
    takes = mix(docs, **settings).where("taken > 0").select(key.alias("_key"), "source", F.col("size").alias("_size"), "taken")
    takes = takes.withColumn("_n", F.row_number().over(alike.orderBy("taken")))
    takes = takes.select(F.col("_key").alias("_k"), F.col("source").alias("_s"), F.col("_size").alias("_z"), F.col("_n").alias("_m"), F.col("taken").alias("_taken"))
    # One hash key, so that texts move once; the rest is compared after.
    same = (F.col("_key") == F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_size") - F.col("_z") == 0) & (F.col("_n") - F.col("_m") == 0)
    taken = rows.join(takes, same)
    copies = taken.withColumn("_words", F.explode(F.expr("concat(array_repeat(_size, int(_taken div _size)), if(_taken % _size > 0, array(_taken % _size), array()))")))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_words").cast("int")), " ")
    copies = copies.withColumn("text", F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.length("text").cast("long"))
    return copies.select(docs.columns)
