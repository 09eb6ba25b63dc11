"""Paths of several steps, folded over joins; paths and labels of nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shuffled
from .steps import step, test


@dataclass(frozen=True)
class At:
    """The n-th node (from 1) of each context in document order, nearest first on ancestor axes; or n-th from the end.

    With `whole` it is the n-th of all that the step has found in a tree, whatever the contexts; a node found twice counts twice.
    """

    n: int
    last: bool = False
    whole: bool = False


@dataclass(frozen=True)
class Has:
    """Whether a path from the node finds anything (or nothing)."""

    steps: tuple[Step, ...]
    negate: bool = False


@dataclass(frozen=True)
class Step:
    """Nodes of a kind on an axis, filtered by predicates in turn: a Column, an At or a Has."""

    axis: str = "child"
    kind: str | None = None
    where: tuple = ()


def path(context: DataFrame, nodes: DataFrame, steps: tuple[Step, ...] | list[Step], distinct: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Nodes that the steps lead to from each context row: a multiset, or distinct nodes after each step.

    `carry` columns of the context come along, in place of a node's own of the same name.
    """
    # on the way, carried columns have names of their own: nodes may have columns of the same name
    rows, kept = context.withColumns({f"_carry_{k}": F.col(c) for k, c in enumerate(carry)}), [f"_carry_{k}" for k in range(len(carry))]
    for s in steps:
        rows = step(rows, nodes, s.axis, s.kind, ("node_id", *kept)).withColumnsRenamed({f"ctx_{c}": c for c in kept})
        per = Window.partitionBy("tree_id", "ctx_node_id", *kept)
        for p in s.where:
            if isinstance(p, At):  # a context that comes twice has its node twice
                order = F.desc("node_id") if p.last != s.axis.startswith("ancestor") else F.asc("node_id")
                at = F.row_number().over(Window.partitionBy("tree_id").orderBy(order, *kept)) if p.whole else F.dense_rank().over(per.orderBy(order))
                rows = rows.withColumn("_at", at).filter(F.col("_at") == p.n).drop("_at")
            elif isinstance(p, Has):
                rows = having(rows, nodes, p)
            else:
                rows = rows.filter(test(p))
        rows = rows.drop("ctx_node_id")
        if distinct:
            rows = rows.dropDuplicates(["tree_id", "node_id", *kept])
    return rows.drop(*carry).withColumnsRenamed(dict(zip(kept, carry)))


def having(rows: DataFrame, nodes: DataFrame, p: Has) -> DataFrame:
    """Rows from which the path finds a node (or none)."""
    starts = rows.select(*[c for c in nodes.columns]).dropDuplicates(["tree_id", "node_id"]).withColumn("_from", F.col("node_id"))
    met = path(starts, nodes, p.steps, distinct=True, carry=("_from",)).select("tree_id", F.col("_from").alias("node_id")).distinct()
    return rows.join(shuffled(met), ["tree_id", "node_id"], "left_anti" if p.negate else "left_semi")


def ordinals(nodes: DataFrame) -> DataFrame:
    """nodes with `ordinal`, the place among siblings of the same kind."""
    w = Window.partitionBy("tree_id", "parent_id", "kind").orderBy("node_id")
    return nodes.withColumn("ordinal", F.row_number().over(w))


def kth_siblings(nodes: DataFrame, column: str, k: int) -> DataFrame:
    """nodes with `earlier` and `later`: the column of the k-th sibling before and after."""
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id")
    return nodes.withColumns({"earlier": F.lag(column, k).over(w), "later": F.lead(column, k).over(w)})


def node_paths(context: DataFrame, nodes: DataFrame, label: F.Column) -> DataFrame:
    """context with `path`: labels of a node's ancestors and its own, from the root down. label: of the columns of ordinals()."""
    named = ordinals(nodes).select("tree_id", F.col("node_id").alias("up"), label.alias("label"))
    mine = context.join(named.select("tree_id", F.col("up").alias("node_id"), F.col("label").alias("_label")), ["tree_id", "node_id"])
    # most nodes have nothing below them: the labels of a path are gathered once for all children of its last node
    tops = context.filter("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id"), "anc").dropDuplicates(["tree_id", "node_id"])
    ups = tops.select("tree_id", F.col("node_id").alias("parent_id"), F.explode("anc").alias("up"))
    met = ups.join(named, ["tree_id", "up"]).groupBy("tree_id", "parent_id").agg(F.sort_array(F.collect_list(F.struct("up", "label"))).alias("parts"))  # one for each level
    above = met.select("tree_id", "parent_id", F.concat(F.lit("/"), F.array_join(F.transform("parts", lambda x: x["label"]), "/")).alias("_above"))
    return mine.join(above, ["tree_id", "parent_id"], "left").withColumn("path", F.concat(F.coalesce("_above", F.lit("")), F.lit("/"), "_label")).drop("_above", "_label")


def limited(nodes: DataFrame, depth: int, base: int = 0) -> DataFrame:
    """Nodes of up to `depth` levels below depth `base`, with `children` and whether these are cut off (`truncated`)."""
    below = nodes.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("children"))
    rows = nodes.filter((F.col("depth") >= base) & (F.col("depth") <= base + depth)).join(below, ["tree_id", "node_id"], "left")
    children = F.coalesce("children", F.lit(0).cast("long"))
    return rows.withColumns({"children": children, "truncated": (F.col("depth") == base + depth) & (children > 0)})


def lines(nodes: DataFrame, label: F.Column, indent: int = 2) -> DataFrame:
    """A line of text for each node in document order, indented by depth."""
    return nodes.withColumn("line", F.concat(F.repeat(F.lit(" "), F.col("depth") * indent), label)).orderBy("tree_id", "node_id")
