"""Conversations: pairs of turns, formatted as chunks and numbered on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, human, assistant of each user turn that an assistant turn follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    led = turns.withColumn("_role", F.lead("role").over(order)).withColumn("_text", F.lead("text").over(order))
    return led.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("human"), F.col("_text").alias("assistant"))


def formatted(pairs: DataFrame, *order: str) -> DataFrame:
    """order, part (0, 1) and text: two chunks a pair, neither split nor dropped."""
    parts = F.posexplode(F.array(F.concat(F.lit("Human: "), F.col("human")), F.concat(F.lit("Assistant: "), F.col("assistant")))).alias("part", "text")
    return pairs.select(*order, parts)


def numbered(rows: DataFrame, order: list[str], group: str, start: int, span: int = 4096) -> DataFrame:
    """rows with id from start on, by order; group is an integer column that leads order.

    Ranks are made within ranges of span groups and moved on by the counts of
    the ranges before.
    """
    ranged = rows.withColumn("_range", F.expr(f"`{group}` div {span}"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    sums = ranged.groupBy(F.col("_range").alias("_r")).count()
    before = sums.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    joined = ranged.withColumn("_rank", rank).join(before, F.col("_range") == F.col("_r"))
    return joined.withColumn("id", F.lit(start) + F.col("_before") + F.col("_rank")).drop("_range", "_rank", "_r", "_before")
