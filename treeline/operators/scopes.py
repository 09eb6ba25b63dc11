"""Names that are visible at a point, and the declarations that uses of names mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import dealt, shuffled, stored


def declared_in(declarations: DataFrame, scopes: DataFrame) -> DataFrame:
    """declarations (tree_id, node_id, anc, name) -> tree_id, scope, decl, name: scope is the nearest of `scopes` (tree_id, node_id) around; what none is around declares nothing."""
    around = scopes.select("tree_id", F.col("node_id").alias("scope"))
    ups = declarations.select("tree_id", F.col("node_id").alias("decl"), "name", F.explode("anc").alias("scope"))
    return ups.join(around, ["tree_id", "scope"]).groupBy("tree_id", "decl", "name").agg(F.max("scope").alias("scope"))


def visible(points: DataFrame, declarations: DataFrame, scopes: DataFrame, most: int | None = None) -> DataFrame:
    """tree_id, node_id, name, decl, scope: what each name means at each point (tree_id, node_id, anc).

    Of the declarations before the point in all scopes around it, the innermost scope's counts for a
    name, and of several there the last. With `most`, a point keeps so many names: those of the
    innermost scopes, and of a scope the last declared. Joins are by scope, and a point's own names
    are all that meets in a task.
    """
    around = points.select("tree_id", "node_id", F.explode("anc").alias("scope"))
    met = around.join(declared_in(declarations, scopes), ["tree_id", "scope"]).filter("decl < node_id")
    best = met.groupBy("tree_id", "node_id", "name").agg(F.max(F.struct("scope", "decl")).alias("x"))
    rows = best.select("tree_id", "node_id", "name", F.col("x.decl").alias("decl"), F.col("x.scope").alias("scope"))
    if most is None:
        return rows
    order = Window.partitionBy("tree_id", "node_id").orderBy(F.desc("scope"), F.desc("decl"))
    return rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most).drop("_at")


def meant(uses: DataFrame, declarations: DataFrame, scopes: DataFrame) -> DataFrame:
    """tree_id, node_id, name, decl of each use (tree_id, node_id, anc, name): the declaration that it means, null if there is none.

    Declarations and uses of a name in a scope are read in turn, each use with the last declaration before it: no pairs of them.
    """
    n = uses.select("anc").unionByName(declarations.select("anc")).agg(F.sum(F.size("anc")).alias("n")).first()["n"] or 0
    around, none = scopes.select("tree_id", F.col("node_id").alias("scope")), F.lit(None).cast("long")
    points = uses.select("tree_id", "name", F.explode("anc").alias("scope"), "node_id").join(around, ["tree_id", "scope"])
    points = points.select("tree_id", "name", "scope", F.col("node_id").alias("at"), none.alias("decl"))
    of = declared_in(declarations, scopes).select("tree_id", "name", "scope", F.col("decl").alias("at"), F.col("decl").cast("long").alias("decl"))
    # a declaration comes after the uses at its own place
    order = Window.partitionBy("tree_id", "name", "scope").orderBy("at", F.asc_nulls_first("decl")).rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(of).withColumn("last", F.last("decl", ignorenulls=True).over(order)).filter("decl is null and last is not null")
    best = met.groupBy("tree_id", F.col("at").alias("node_id"), "name").agg(F.max(F.struct("scope", "last")).alias("x"))
    found = stored(best.select("tree_id", "node_id", "name", F.col("x.last").alias("decl")), "meant", n)
    key = ["tree_id", "node_id", "name"]
    return uses.select(*key).join(shuffled(dealt(found, n, *key)), key, "left")
