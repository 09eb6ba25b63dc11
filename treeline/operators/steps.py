"""Path steps as self-joins on (tree, interval), positions as windows. Results are multisets in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import dealt

#: Join condition of each axis between a context row c and a node row n of the same tree.
AXES = {
    "self": "n.node_id = c.node_id",
    "child": "n.parent_id = c.node_id",
    "parent": "n.node_id = c.parent_id",
    "descendant": "n.node_id > c.node_id AND n.node_id <= c.sub_end",
    "descendant-or-self": "n.node_id >= c.node_id AND n.node_id <= c.sub_end",
    "ancestor": "n.node_id < c.node_id AND n.sub_end >= c.node_id",
    "ancestor-or-self": "n.node_id <= c.node_id AND n.sub_end >= c.node_id",
    "following-sibling": "n.parent_id = c.parent_id AND n.node_id > c.node_id",
    "preceding-sibling": "n.parent_id = c.parent_id AND n.node_id < c.node_id",
    # within the parent's subtree
    "following": "n.node_id > c.node_id AND n.node_id <= c.parent_end",
    "preceding": "n.node_id > c.parent_id AND n.node_id < c.node_id",
}


#: The same where nodes carry their ancestors (anc): equi-joins, so that a large tree spreads over tasks. `up` is an exploded ancestor.
NEAR = {
    "descendant": "n.up = c.node_id",
    "descendant-or-self": "n.up = c.node_id",
    "ancestor": "n.node_id = c.up",
    "ancestor-or-self": "n.node_id = c.up",
    "following": "n.up = c.parent_id AND n.node_id > c.node_id",
    "preceding": "n.up = c.parent_id AND n.node_id < c.node_id",
}


def _sides(context: DataFrame, nodes: DataFrame, axis: str, kind: str | None) -> tuple[DataFrame, DataFrame, str]:
    """Both sides and the condition of an axis."""
    c, n = context, nodes if kind is None else nodes.filter(F.col("kind") == kind)
    if axis in NEAR and "anc" in context.columns and "anc" in nodes.columns:
        up = F.explode(F.concat("anc", F.array("node_id")) if axis.endswith("-or-self") else F.col("anc"))
        if axis.startswith("ancestor"):
            c = c.withColumn("up", up)
        else:
            n = n.withColumn("up", up)
        return c, n, f"c.tree_id = n.tree_id AND {NEAR[axis]}"
    if axis in ("following", "preceding"):
        ends = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"), F.col("sub_end").alias("parent_end"))
        c = c.join(ends, (F.col("tree_id") == F.col("t")) & (F.col("parent_id") == F.col("p")), "left").drop("t", "p")
    return c, n, f"c.tree_id = n.tree_id AND {AXES[axis]}"


def step(context: DataFrame, nodes: DataFrame, axis: str, kind: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nodes on the axis of each context row; `keep` columns of the context come along as ctx_*."""
    c, n, on = _sides(context, nodes, axis, kind)
    return c.alias("c").join(n.alias("n"), F.expr(on)).select(*[F.col(f"n.{x}") for x in nodes.columns], *[F.col(f"c.{k}").alias(f"ctx_{k}") for k in keep])


def exists(context: DataFrame, nodes: DataFrame, axis: str, kind: str | None = None, negate: bool = False, rows: int = 0) -> DataFrame:
    """Context rows with (or without) a node on the axis: a semi or anti join; on descendant axes it is dealt as `rows`, the number of context rows, needs it."""
    c, n, on = _sides(context, nodes, axis, kind)
    if "up" in n.columns:
        n = dealt(n.select("tree_id", "up"), rows, "tree_id", "up") if axis.startswith("descendant") else n
    how = "left_anti" if negate else "left_semi"
    if "up" in c.columns and "up" not in context.columns:  # a row for each ancestor: those that meet a node mark their row
        met = c.alias("c").join(n.alias("n"), F.expr(on), "left_semi").select("tree_id", "node_id").distinct()
        return context.join(met, ["tree_id", "node_id"], how)
    return c.alias("c").join(n.alias("n"), F.expr(on), how).select(*[F.col(f"c.{x}") for x in context.columns])


def position(rows: DataFrame, n: int, per: list[str], from_end: bool = False) -> DataFrame:
    """The n-th row (from 1) in document order of each group."""
    order = F.desc("node_id") if from_end else F.asc("node_id")
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*per).orderBy(order))).filter(F.col("_at") == n).drop("_at")


def test(column: F.Column) -> F.Column:
    """Two-valued predicate: a missing attribute is false."""
    return F.coalesce(column, F.lit(False))


def same(a: F.Column, value: str) -> F.Column:
    return test(F.upper(a) == value.upper())


def differs(a: F.Column, value: str) -> F.Column:
    """Not equal, ignoring case; a missing attribute differs from nothing."""
    return test(F.upper(a) != value.upper())


def is_true(a: F.Column) -> F.Column:
    """A flag given as text."""
    return same(a.cast("string"), "true")


def holds(a: F.Column, value: str) -> F.Column:
    return test(F.contains(F.upper(a), F.lit(value.upper())))


def wildcard(a: F.Column, pattern: str) -> F.Column:
    """* and ? over the whole name, ignoring case."""
    import re

    quoted = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return test(F.coalesce(a, F.lit("")).rlike(f"(?is)^{quoted}$"))


def edge_wildcard(a: F.Column, pattern: str) -> F.Column:
    """The second form: only a leading and a trailing * count, ignoring case."""
    name, text = F.upper(F.coalesce(a, F.lit(""))), F.lit(pattern.strip("*").upper())
    if pattern.startswith("*") and pattern.endswith("*"):
        return F.contains(name, text)
    if pattern.startswith("*"):
        return F.endswith(name, text)
    return F.startswith(name, text) if pattern.endswith("*") else name == text


def attribute(nodes: DataFrame, name: str) -> F.Column:
    """A node's attribute as text; null if nodes have none of that name."""
    return F.col(name).cast("string") if name in nodes.columns else F.lit(None).cast("string")


def attributes(nodes: DataFrame, *names: str) -> F.Column:
    """Those attributes that a node has, as a map."""
    pairs = [x for n in names for x in (F.lit(n), attribute(nodes, n))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
