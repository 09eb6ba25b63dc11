"""Nodes by region and point, intervals that overlap, and the nearest enclosing node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inside(nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Nodes whose whole subtree lies in [first, last]."""
    return nodes.filter((F.col("node_id") >= first) & (F.col("sub_end") <= last))


def innermost(nodes: DataFrame, at: int) -> DataFrame:
    """For each tree the deepest node whose interval holds the point: the largest pre-order number among them."""
    around = nodes.filter((F.col("node_id") <= at) & (F.col("sub_end") >= at))
    return around.groupBy("tree_id").agg(F.max_by(F.struct(*nodes.columns), "node_id").alias("n")).select("n.*")


def nearest(context: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Each context row with `found`, the node_id of its nearest ancestor of the kind; null if there is none.

    One equi-join of exploded ancestors (anc) with the nodes of the kind; of those met, the largest
    pre-order number is the nearest.
    """
    ups = context.select("tree_id", "node_id", F.explode("anc").alias("up")).distinct()
    of_kind = nodes.filter(F.col("kind") == kind).select("tree_id", F.col("node_id").alias("up"))
    found = ups.join(of_kind, ["tree_id", "up"]).groupBy("tree_id", "node_id").agg(F.max("up").alias("found"))
    return context.join(found, ["tree_id", "node_id"], "left")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 1) -> DataFrame:
    """Pairs of intervals (key, id, first, last; whole numbers) of the same key that overlap: (key, a, b).

    Bins have widths that are powers of two, `width` or more. Intervals meet at the level of the longer
    one, where either touches two bins at most, so that a long interval costs no more rows than a
    short one: two for each level from its own on. A pair counts in the bin where the later begins.
    """

    def level(x: DataFrame) -> DataFrame:
        own = F.ceil(F.log2((F.col("last") - F.col("first") + 1).cast("double"))).cast("int")
        return x.filter("first <= last").select(key, "id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.greatest(own, F.lit(max(0, (width - 1).bit_length()))).alias("own"))

    a, b = level(a), level(b)
    levels = a.select("own").unionByName(b.select("own")).distinct().agg(F.sort_array(F.collect_set("own")).alias("levels"))  # one row, 64 numbers at most

    def binned(x: DataFrame, name: str) -> DataFrame:
        rows = x.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda k: k >= F.col("own"))))
        bins = F.explode(F.sequence(F.expr("shiftright(first, level)"), F.expr("shiftright(last, level)")))
        return rows.select(key, "level", F.col("id").alias(name), F.col("first").alias(f"{name}1"), F.col("last").alias(f"{name}2"), F.col("own").alias(f"{name}_own"), bins.alias("bin"))

    pairs = binned(a, "a").join(binned(b, "b"), [key, "level", "bin"]).filter("level = greatest(a_own, b_own)")
    return pairs.filter("greatest(a1, b1) <= least(a2, b2) and bin = shiftright(greatest(a1, b1), level)").select(key, "a", "b")


def spots_within(spans: DataFrame, spots: DataFrame) -> DataFrame:
    """spans (tree_id, span, begin, stop) with n_spots, how many of spots (tree_id, at) have begin <= at < stop.

    Ends and spots of a tree stand in one order, and a running count at a span's two ends tells its
    number: no span meets its spots one by one, however deep spans lie within each other. A span that
    ends before it begins holds nothing; `span` is unique in a tree.
    """
    none = F.lit(0)
    ends = spans.select("tree_id", F.explode(F.array("begin", F.greatest("begin", "stop"))).alias("at"), "span", none.alias("spot"))
    points = ends.unionByName(spots.select("tree_id", "at", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), F.lit(1).alias("spot")))
    # of points at one place, ends come before spots
    order = Window.partitionBy("tree_id").orderBy("at", "spot").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.withColumn("_n", F.sum("spot").over(order)).filter("spot = 0").groupBy("tree_id", "span").agg((F.max("_n") - F.min("_n")).alias("n_spots"))
    return spans.join(counted, ["tree_id", "span"])
