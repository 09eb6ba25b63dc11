"""Stored tables are joined by shuffle, however small their files."""

from pyspark.sql import functions as F

from treeline.operators import forest
from treeline.sources import folders


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_stored_rows_are_not_gathered_on_the_driver(spark):
    rows = folders.stored(spark.range(300000).select(F.lit(7).alias("tree_id"), F.col("id").alias("at")), "joins")
    for joined in (rows.filter("at > 5").join(rows.groupBy("tree_id", "at").count(), ["tree_id", "at"]), rows.join(rows.filter("at < 9"), "at", "left_semi")):
        assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)


def test_tours_are_joined_by_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, None, 0), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 2, 0)], "tree_id long, node long, parent long, place long")
    numbers = forest.forest_numbers(rows, "place")
    assert "Broadcast" not in plan(numbers)
    assert sorted((r["node"], r["node_id"], r["sub_end"], r["depth"]) for r in numbers.collect()) == [(1, 0, 3, 0), (2, 1, 2, 1), (3, 3, 3, 1), (4, 2, 2, 2)]
