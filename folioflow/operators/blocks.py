"""Words of a page grouped into text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.layout import block_class, boxes_overlap


def outside_boxes(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Words that touch none of the boxes on their page."""
    w, b = words.alias("w"), boxes.alias("b")
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return w.join(b, cond & boxes_overlap(F.struct("w.x0", "w.top", "w.x1", "w.bottom"), F.struct("b.x0", "b.top", "b.x1", "b.bottom")), "left_anti")


def word_blocks(words: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """A row per block: text, box, largest font, boldness and class, numbered in reading order.

    A word joins its predecessor's block if their tops are less than 5 apart, or if it begins less than one and a half of its
    font sizes below the predecessor and their sizes differ by less than 2. A negative gap, as of a new column, continues the
    block. A NULL font size counts as 10. Blocks whose words are all blank are dropped.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    sized = words.withColumn("size", F.coalesce("size", F.lit(10.0)))
    before = {c: F.lag(c).over(w) for c in ("top", "bottom", "size")}
    near = F.abs(F.col("top") - before["top"]) < 5
    below = (F.col("top") - before["bottom"] < F.col("size") * 1.5) & (F.abs(F.col("size") - before["size"]) < 2)
    opened = sized.withColumn("_new", F.when(before["top"].isNull() | ~(near | below), 1).otherwise(0))
    numbered = opened.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = numbered.groupBy(*keys, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.max("size").alias("font_size"),
        F.bool_or(F.coalesce(F.contains("fontname", F.lit("Bold")), F.lit(False))).alias("is_bold"),
        F.count("*").alias("n_words"),
    )
    blocks = blocks.where(F.length(F.trim("text")) > 0)
    return blocks.withColumn("type", block_class(F.col("font_size"), F.col("is_bold"), F.length("text")))


def reading_order(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers elements from the top, then from the left; ties keep the order ``ord``."""
    return elements.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("top", "x0", "ord")))


def valid_tables(tables: DataFrame) -> DataFrame:
    """Tables of more than one row. The words of others stay text, since they aren't excluded either."""
    return tables.where(F.size("rows") > 1)
