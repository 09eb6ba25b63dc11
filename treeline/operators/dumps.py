"""Trees as nested text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nested(nodes: DataFrame, depth: int, most: int, fields: tuple[str, ...] = ("kind",)) -> DataFrame:
    """tree_id, node_id, dump: each root as JSON to a depth, with at most `most` children of an element.

    Values are folded upward a level at a time: each level's go into their parents' by one aggregation
    of at most `most` values, so a value is bounded by most ** depth. `truncated` says that children are
    left out, by number or by depth.
    """
    sibling = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    rows = nodes.filter(F.col("depth") <= depth).withColumn("_place", F.row_number().over(sibling))
    rows = rows.filter((F.col("_place") <= most) | (F.col("depth") == 0))
    counts = nodes.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, ["tree_id", "node_id"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    below = None
    for d in range(depth, -1, -1):
        level = rows.filter(F.col("depth") == d)
        if below is None:
            level = level.withColumn("_list", F.lit("[]"))
        else:
            values = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "dump"))), lambda x: x["dump"]), ",")
            lists = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.concat(F.lit("["), values, F.lit("]")).alias("_list"))
            level = level.join(lists, ["tree_id", "node_id"], "left").withColumn("_list", F.coalesce("_list", F.lit("[]")))
        cut_off = F.col("_n") > (most if d < depth else 0)
        texts = [x for f in fields for x in (F.lit(f'"{f}":'), F.to_json(F.array(f)).substr(F.lit(2), F.length(F.to_json(F.array(f))) - 2), F.lit(","))]
        dump = F.concat(F.lit("{"), *texts, F.lit('"node":'), F.col("node_id").cast("string"), F.lit(',"truncated":'), cut_off.cast("string"), F.lit(',"children":'), "_list", F.lit("}"))
        below = level.select("tree_id", "node_id", "parent_id", dump.alias("dump"))
    return below.select("tree_id", "node_id", "dump")
