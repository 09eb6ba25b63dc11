"""Places in a block that survive edits: labels with gaps, and ids that never change.

A row's place is a label; rows that are put in get labels between their neighbours', so that nothing
else is written. Only a block that has no room left between two rows is labelled anew. Whatever is
kept by (block, id), markers above all, stays right over any number of versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 1 << 20


def labelled(rows: DataFrame, block: str, order: str, gap: int = GAP) -> DataFrame:
    """rows with `label`: their rank in the block times the gap."""
    return rows.withColumn("label", (F.row_number().over(Window.partitionBy(block).orderBy(order)) * gap).cast("long"))


def insert_after(rows: DataFrame, new: DataFrame, block: str, id_col: str, gap: int = GAP) -> DataFrame:
    """rows (with label) and those of `new` (same columns but label, and `after`, the id of the row before; null: the block's start).

    Several rows after one stand in the order of their ids. New rows whose neighbour is gone are dropped.
    """
    key = Window.partitionBy(block).orderBy("label")
    spots = rows.select(block, F.col(id_col).alias("after"), F.col("label").alias("left"), F.lead("label").over(key).alias("right"))
    starts = rows.groupBy(block).agg(F.min("label").alias("right")).select(block, F.lit(None).cast(rows.schema[id_col].dataType).alias("after"), (F.col("right") - gap).alias("left"), "right")
    spots = spots.unionByName(starts).withColumnRenamed(block, "_block").withColumnRenamed("after", "_after")
    met = new.join(spots, (F.col(block) == F.col("_block")) & F.col("after").eqNullSafe(F.col("_after")))
    group = Window.partitionBy(block, "after")
    met = met.withColumns({"_k": F.row_number().over(group.orderBy(id_col)), "_n": F.count(F.lit(1)).over(group)})
    room = F.coalesce(F.col("right"), F.col("left") + gap * (F.col("_n") + 1)) - F.col("left")
    met = met.withColumns({"label": F.col("left") + F.floor(room * F.col("_k") / (F.col("_n") + 1)), "_tight": room <= F.col("_n")})
    both = rows.withColumns({"_side": F.lit(0), "_k": F.lit(0), "_tight": F.lit(False)}).unionByName(met.select(*rows.columns, F.lit(1).alias("_side"), "_k", "_tight"))
    crowded = met.filter("_tight").select(block).distinct()
    fine = both.join(crowded, block, "left_anti")
    # a crowded block keeps its order: where labels are equal, the row before, then the new ones by number
    order = Window.partitionBy(block).orderBy("label", "_side", "_k")
    anew = both.join(crowded, block, "left_semi").withColumn("label", (F.row_number().over(order) * gap).cast("long"))
    return fine.unionByName(anew).select(*rows.columns)


def places(rows: DataFrame, block: str) -> DataFrame:
    """rows with `place`, counted from 1 in the order of labels."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(block).orderBy("label")).cast("long"))
