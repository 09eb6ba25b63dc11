"""Control flow and data flow of ordered and of nested statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import dealt, shuffled, stored


def control_flow(rows: DataFrame, region: str, order: tuple[str, ...], kind: str, returns: tuple[str, ...], others: tuple[str, ...] = ()) -> DataFrame:
    """For each region: how many returns, the kinds of exits, and whether its end is reached.

    The last statement of a region decides the latter; aggregates alone, combined before the shuffle.
    """
    leaves = F.col(kind).isin(*returns, *others)
    return rows.groupBy(region).agg(
        F.count(F.when(F.col(kind).isin(*returns), 1)).alias("exits"),
        F.array_join(F.sort_array(F.collect_set(F.when(leaves, F.col(kind)))), ",").alias("kinds"),
        (~F.coalesce(F.max_by(leaves, F.struct(*order)), F.lit(False))).alias("end_reachable"),
    )


def region_sets(accesses: DataFrame, first: int, last: int) -> DataFrame:
    """accesses (var, pos, is_write) -> flags of each variable that the region [first, last] touches.

    flows_in: read in the region before it is written there, and written earlier; flows_out: written
    there and read later; declared: written there and not touched earlier. One aggregate, combined
    before the shuffle.
    """
    inside, write, pos = F.col("pos").between(first, last), F.col("is_write"), F.col("pos")
    any_ = lambda c: F.coalesce(F.max(c), F.lit(False))
    f = accesses.groupBy("var").agg(
        any_(inside & ~write).alias("read_inside"), any_(inside & write).alias("written_inside"), any_(pos < first).alias("earlier"), any_(write & (pos < first)).alias("written_before"),
        any_(~write & (pos > last)).alias("read_after"), F.min(F.when(inside & ~write, pos)).alias("r"), F.min(F.when(inside & write, pos)).alias("w"),
    )
    f = f.filter("read_inside or written_inside")
    flows_in = F.expr("read_inside and written_before and (w is null or r < w)")
    return f.select("var", "read_inside", "written_inside", flows_in.alias("flows_in"), F.expr("written_inside and read_after").alias("flows_out"), F.expr("written_inside and not earlier").alias("declared"))


def spans(blocks: DataFrame) -> DataFrame:
    """blocks (tree_id, node_id, parent_id, anc, role) with stop and stop_role, the nearest branch or loop around a node, and `up`: the nodes from there (without it) to the node itself."""
    stops = blocks.filter(F.col("role").isin("branch", "loop")).select("tree_id", F.col("node_id").alias("above"), F.col("role").alias("of"))
    ups = blocks.select("tree_id", "node_id", F.explode("anc").alias("above")).join(stops, ["tree_id", "above"])
    near = ups.groupBy("tree_id", "node_id").agg(F.max(F.struct("above", "of")).alias("s"))
    met = blocks.join(shuffled(near), ["tree_id", "node_id"], "left").select(*blocks.columns, F.col("s.above").alias("stop"), F.col("s.of").alias("stop_role"))
    chain = F.concat("anc", F.array("node_id"))
    return met.withColumn("up", F.filter(chain, lambda x: F.col("stop").isNull() | (x > F.col("stop"))))


def chains(blocks: DataFrame) -> int:
    """How many rows the chains of all blocks have, from the root down to the block itself."""
    return blocks.agg(F.sum(F.size("anc") + 1).alias("n")).first()["n"] or 0


def always_assigned(blocks: DataFrame, assigned: DataFrame) -> DataFrame:
    """(tree_id, node_id, var): what a block surely assigns once it has ended.

    blocks: trees of statements (tree_id, node_id, parent_id, anc, role); a role is seq (children run in
    turn), branch (one child of all runs) or loop (children may not run at all). assigned (tree_id,
    node_id, var): statements that assign. A sequence assigns what any child does, a branch what every
    child does, a loop nothing, whatever stands in it. What is assigned below the nearest branch or
    loop goes up there in one join, so rounds are as many as branches lie within each other.
    """
    n = chains(blocks)
    of = stored(spans(blocks), "spans", n)
    children = blocks.groupBy("tree_id", F.col("parent_id").alias("stop")).agg(F.count(F.lit(1)).alias("children"))
    new, levels = assigned.select("tree_id", "node_id", "var").distinct(), []
    while True:
        at = new.join(of.select("tree_id", "node_id", "stop", "stop_role", "up"), ["tree_id", "node_id"])
        levels.append(stored(at.select("tree_id", F.explode("up").alias("node_id"), "var").distinct(), "assigned", n))
        arms = at.filter("stop_role = 'branch'").select("tree_id", "stop", F.element_at("up", 1).alias("arm"), "var").distinct()
        if len(levels) > 1:  # arms that earlier rounds have found count with the new ones
            arms = arms.unionByName(found).distinct()
        found = stored(arms, "arms", n)
        every = found.groupBy("tree_id", "stop", "var").agg(F.count(F.lit(1)).alias("n")).join(children, ["tree_id", "stop"]).filter("n = children")
        new = every.select("tree_id", F.col("stop").alias("node_id"), "var")
        for level in levels:
            new = new.join(level, ["tree_id", "node_id", "var"], "left_anti")
        new = stored(new, "branches", n)
        if new.isEmpty():
            break
    if len(levels) == 1:
        return levels[0]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return stored(out.distinct(), "always", n)


def conditional_assignments(blocks: DataFrame, assigned: DataFrame) -> DataFrame:
    """(tree_id, node_id, var): what is assigned somewhere below a block, but not surely."""
    chain = blocks.select("tree_id", "node_id", F.concat("anc", F.array("node_id")).alias("up"))
    below = assigned.join(chain, ["tree_id", "node_id"]).select("tree_id", F.explode("up").alias("node_id"), "var").distinct()
    below, key = stored(below, "below", chains(blocks)), ["tree_id", "node_id", "var"]
    return below.join(shuffled(dealt(always_assigned(blocks, assigned), below.count(), *key)), key, "left_anti")


def unreachable(blocks: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree_id, node_id) of blocks whose end is never reached, and of statements that never run.

    exits (tree_id, node_id): statements that leave all blocks around them. An end is not reached where
    an exit is surely met, which goes up as assignments do; what stands after such a block among the
    children of a sequence or loop never runs, nor does anything below.
    """
    stuck = always_assigned(blocks, exits.select("tree_id", "node_id", F.lit("exit").alias("var"))).select("tree_id", "node_id")
    rows = shuffled(blocks.join(stuck, ["tree_id", "node_id"], "left_semi")).filter("parent_id is not null")
    first = rows.groupBy("tree_id", "parent_id").agg(F.min("node_id").alias("first"))
    ordered = blocks.filter("role <> 'branch'").select("tree_id", F.col("node_id").alias("parent_id"))
    after = blocks.join(shuffled(first.join(ordered, ["tree_id", "parent_id"], "left_semi")), ["tree_id", "parent_id"]).filter("node_id > first").select("tree_id", F.col("node_id").alias("dead"))
    chain = blocks.select("tree_id", "node_id", F.explode(F.concat("anc", F.array("node_id"))).alias("dead"))
    return stuck, shuffled(chain.join(shuffled(after), ["tree_id", "dead"], "left_semi").select("tree_id", "node_id").distinct())
