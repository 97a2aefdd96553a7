"""Tables as long cells: HTML scan, grid expansion, signatures and typed cell comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.normalize import normalize


def html_tags(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, at, tag): opening tags in the order in which they stand, lower-cased."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    return pages.select(id_col, F.posexplode(tags).alias("at", "tag"))


def html_cells(tables: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, row, col, rowspan, colspan, text): cells of simple tables, placed on the grid.

    Columns are moved right by the spans before them in the row, and by rows above that reach down.
    """
    rows = tables.select(id_col, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    cells = rows.select(id_col, "row", F.posexplode(F.regexp_extract_all("_r", F.lit(r"(?is)(<t[dh][^>]*>.*?)</t[dh]>"), F.lit(1))).alias("_n", "_c"))
    span = lambda name: F.coalesce(F.expr(f"try_cast(regexp_extract(_c, '(?i){name}=\"?([0-9]+)', 1) as int)"), F.lit(1))
    text = F.trim(F.regexp_replace(F.regexp_replace("_c", r"<[^>]+>", ""), r"\s+", " "))
    placed = cells.select(id_col, "row", "_n", span("rowspan").alias("rowspan"), span("colspan").alias("colspan"), text.alias("text"))
    grouped = placed.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("row", "_n", "rowspan", "colspan", "text"))).alias("_cells"))
    start = F.struct(F.expr("cast(array() as array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>)").alias("out"))

    def put(acc: Column, c: Column) -> Column:
        # Places that earlier cells take in this row; the cell goes to the first free one.
        taken = F.flatten(F.transform(F.filter(acc["out"], lambda o: (o["row"] <= c["row"]) & (c["row"] < o["row"] + o["rowspan"])), lambda o: F.sequence(o["col"], o["col"] + o["colspan"] - 1)))
        limit = F.coalesce(F.array_max(taken), F.lit(-1)) + 1
        # Within a row cells never move left of the row's last own cell.
        own = F.coalesce(F.array_max(F.transform(F.filter(acc["out"], lambda o: o["row"] == c["row"]), lambda o: o["col"] + o["colspan"])), F.lit(0))
        free = F.array_min(F.filter(F.sequence(own, F.greatest(own, limit)), lambda p: ~F.array_contains(taken, p)))
        cell = F.struct(c["row"].alias("row"), free.cast("int").alias("col"), c["rowspan"].alias("rowspan"), c["colspan"].alias("colspan"), c["text"].alias("text"))
        return F.struct(F.array_append(acc["out"], cell).alias("out"))

    folded = grouped.select(id_col, F.explode(F.aggregate("_cells", start, put, lambda a: a["out"])).alias("c"))
    return folded.select(id_col, "c.*")


def expand_spans(cells: DataFrame, id_col: str) -> DataFrame:
    """(id, row, col, text, anchor): every grid place, an anchor being the cell's first place."""
    rows = cells.withColumn("_r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1))).withColumn("_c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)))
    return rows.select(id_col, F.col("_r").alias("row"), F.col("_c").alias("col"), "text", ((F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col"))).alias("anchor"))


def position_label(row: Column, col: Column) -> Column:
    """A1-style name of a cell from 0-based row and column, up to ZZ."""
    letter = lambda i: F.char(F.lit(65) + i)
    name = F.when(col < 26, letter(col)).otherwise(F.concat(letter(F.floor(col / 26) - 1), letter(col % 26)))
    return F.concat(name, (row + 1).cast("string"))


def cell_changes(original: DataFrame, compare: DataFrame, keys: list[str], value: str, folded: Column) -> DataFrame:
    """Cells whose folded value differs, or that stand on one side alone: keys, status, before, after."""
    a = original.select(*keys, F.col(value).alias("before"), folded.alias("_x"))
    b = compare.select(*keys, F.col(value).alias("after"), folded.alias("_y"))
    both = a.join(b, keys, "full_outer").where(~F.col("_x").eqNullSafe(F.col("_y")))
    status = F.when(F.col("_y").isNull(), "DELETE").when(F.col("_x").isNull(), "ADD").otherwise("MODIFY")
    return both.select(*keys, status.alias("status"), "before", "after")


def stitch_tables(tables: DataFrame, doc: str, page: str, header: str) -> DataFrame:
    """Adds table_group: a table whose header repeats on the next page goes on from the one before."""
    window = Window.partitionBy(doc).orderBy(page)
    goes_on = (F.col(header) == F.lag(header).over(window)) & (F.col(page) - F.lag(page).over(window) <= 1)
    rows = tables.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("table_group", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def interval_clusters(df: DataFrame, keys: list[str], lo: str, hi: str, gap: float, name: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Adds a cluster number: intervals closer than ``gap`` to what lies before them join it."""
    window = Window.partitionBy(*keys).orderBy(lo, hi, *tie)
    reach = F.max(hi).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(F.col(lo) - reach <= gap, 0).otherwise(1))
    return rows.withColumn(name, F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


# The words of a table's text that tell its type, in the order in which types are tried.
TABLE_WORDS = {
    "product": ("产品名称", "详细配置", "单价", "金额", "标的物"),
    "payment": ("付款", "支付", "付款节点", "付款条件", "进度款", "验收款"),
    "acceptance": ("验收", "标准", "指标", "测试"),
    "contact": ("联系人", "电话", "邮箱", "通讯地址"),
    "cover": ("甲方", "乙方", "签订日期", "合同编号", "签订地点"),
}


def table_type(text: Column) -> Column:
    """The type of a table by the words in its folded text, the first that has one; generic without any."""
    flat, found = normalize(text), F.lit("generic")
    for name, words in reversed(TABLE_WORDS.items()):
        found = F.when(flat.rlike("|".join(words)), name).otherwise(found)
    return found
