"""Forests given by parent links: ancestors and pre-order numbers by pointer doubling.

A round joins every pointer with the one that it points to, so that a path of n links takes about
log2(n) rounds, whatever the shape of the tree; no task holds a tree. Rounds are stored below the
shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shuffled, stored


def doubled(links: DataFrame, name: str, combine: dict[str, F.Column]) -> DataFrame:
    """links (tree_id, at, next and values) with values combined along the way to its end.

    `combine` gives each value from those of a link (here.*) and of the one that it points to (there.*).
    Each round doubles how far a link looks; links that have reached the end rest.
    """
    step, names = 0, list(combine)
    state = stored(links, name)
    n = state.count()
    most = n.bit_length() + 1
    while not state.filter("next is not null").isEmpty():
        if step > most:
            raise ValueError("links that never end")
        here, there = state.filter("next is not null").alias("here"), state.alias("there")
        met = here.join(there, F.expr("here.tree_id <=> there.tree_id and here.next = there.at"))
        met = met.select("here.tree_id", "here.at", F.col("there.next").alias("next"), *[combine[n].alias(n) for n in names])
        step += 1
        state = stored(met.unionByName(state.filter("next is null").select("tree_id", "at", "next", *names)), name, n)
    return state


def ancestors(nodes: DataFrame) -> DataFrame:
    """tree_id, node_id, anc: the ids of a node's ancestors from the root down. nodes: tree_id, node_id, parent_id."""
    none = F.array().cast("array<long>")
    links = nodes.select("tree_id", F.col("node_id").alias("at"), F.col("parent_id").alias("next"), F.when(F.col("parent_id").isNull(), none).otherwise(F.array("parent_id")).alias("anc"))
    circle = F.array_contains("there.anc", F.col("here.at"))
    rows = doubled(links, "ancestors", {"anc": F.when(circle, F.raise_error(F.lit("links that never end"))).otherwise(F.concat("there.anc", "here.anc"))})
    return rows.select("tree_id", F.col("at").alias("node_id"), "anc")


def forest_numbers(rows: DataFrame, order: str) -> DataFrame:
    """tree_id, node, node_id, sub_end, depth, parent_id of rows (tree_id, node, parent, order); parent is null for roots.

    The tour of a tree enters and leaves each node once; ranking its links by doubling counts the
    nodes entered from a link on, and how many are still open. Roots and siblings come by `order`
    (then by node); the children of one parent are sorted in a task, nothing else is.
    """
    family = Window.partitionBy("tree_id", "parent").orderBy(order, "node")
    known = rows.select("tree_id", "node", "parent", order, F.lead("node").over(family).alias("sibling"), (F.row_number().over(family) == 1).alias("eldest"))
    first = known.filter("eldest and parent is not null").select("tree_id", F.col("parent").alias("node"), F.col("node").alias("child"))
    known = known.join(shuffled(first), ["tree_id", "node"], "left")

    def end(at: F.Column, after: F.Column, nodes: int, still: int) -> F.Column:
        return F.struct(at.alias("at"), after.alias("next"), F.lit(nodes).cast("long").alias("nodes"), F.lit(still).cast("long").alias("open"))

    into, out = F.col("node") * 2, F.col("node") * 2 + 1
    enter = end(into, F.coalesce(F.col("child") * 2, out), 1, 1)
    leave = end(out, F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1), 0, -1)
    ends = known.select("tree_id", F.explode(F.array(enter, leave)).alias("x")).select("tree_id", "x.*")
    ranked = doubled(ends, "tour", {"nodes": F.col("here.nodes") + F.col("there.nodes"), "open": F.col("here.open") + F.col("there.open")})
    # what an end counts includes itself
    tops = ranked.groupBy("tree_id").agg(F.max("nodes").alias("all"))
    numbers = shuffled(ranked.join(tops, ["tree_id"]))
    node = F.shiftright("at", 1)
    entered = numbers.filter("at % 2 = 0").select("tree_id", node.alias("node"), (F.col("all") - F.col("nodes")).alias("node_id"), (-F.col("open")).cast("int").alias("depth"))
    left = numbers.filter("at % 2 = 1").select("tree_id", node.alias("node"), (F.col("all") - F.col("nodes") - 1).alias("sub_end"))
    out_rows = rows.select("tree_id", "node", "parent").join(entered, ["tree_id", "node"]).join(left, ["tree_id", "node"])
    up = entered.select("tree_id", F.col("node").alias("parent"), F.col("node_id").alias("parent_id"))
    return out_rows.join(up, ["tree_id", "parent"], "left").select("tree_id", "node", "node_id", "sub_end", "depth", "parent_id")
