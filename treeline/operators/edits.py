"""Edits of ordered rows (statements of a block): the result is a new version, numbered anew from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_anew(rows: DataFrame, block: str, at: str, *order: str) -> DataFrame:
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(block).orderBy(*order)).cast("long"))


def insert(rows: DataFrame, new: DataFrame, block: str, at: str, after: bool = True) -> DataFrame:
    """Rows with those of `new` (same columns, `at` naming the neighbour) before or after their neighbours."""
    both = rows.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1 if after else -1)))
    return numbered_anew(both.withColumn("_was", F.col(at)), block, at, "_was", "_side").drop("_was", "_side")


def remove(rows: DataFrame, gone: DataFrame, block: str, at: str) -> DataFrame:
    left = rows.join(gone.select(block, at).distinct(), [block, at], "left_anti")
    return numbered_anew(left.withColumn("_was", F.col(at)), block, at, "_was").drop("_was")


def replace(rows: DataFrame, new: DataFrame, block: str, at: str, column: str) -> DataFrame:
    """`column` taken from `new` (block, at, column; one row each) where it has the row."""
    fresh = new.select(block, at, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = rows.join(fresh, [block, at], "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column)))
    return out.select(*rows.columns)
