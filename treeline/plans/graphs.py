"""Deep and cyclic graphs, and call trees in the order of a walk, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import call_tree, distances, reachable_counts
from ..sources.trees import table
from .catalogue import query

#: Each order of a customer calls the next one.
_NEXT = "SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders"
#: Small returned lines lead from a part to a supplier (negative), large accepted ones from a supplier to a part.
_CYCLES = """SELECT l_partkey AS src, -l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 2 UNION SELECT -l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 50"""


def _next_orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).filter("dst is not null")


def _cycles(spark, sf):
    rows = table(spark, sf, "lineitem")
    back = rows.filter("l_returnflag = 'R' and l_quantity <= 2").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"))
    return back.unionByName(rows.filter("l_returnflag = 'A' and l_quantity >= 50").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))).distinct()


@query("""WITH k AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
  SELECT x.o_orderkey AS src, y.o_orderkey AS dst, (y.r - x.r)::INT AS depth FROM k x JOIN k y ON y.o_custkey = x.o_custkey AND y.r > x.r""")
def callees_any_depth(spark, sf):
    """All orders that an order leads to, at any depth, with the number of calls between."""
    return distances(_next_orders(spark, sf))


@query(f"""WITH RECURSIVE e AS ({_CYCLES}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  c AS (SELECT v.node, least(v.node, coalesce(min(a.dst), v.node)) AS component FROM v LEFT JOIN (SELECT x.src, x.dst FROM r x JOIN r y ON y.src = x.dst AND y.dst = x.src) a ON a.src = v.node GROUP BY v.node)
  SELECT c.node, c.component, count(r.dst) AS reaches FROM c LEFT JOIN r ON r.src = c.node AND r.dst <> c.node GROUP BY 1, 2""")
def cyclic_reach(spark, sf):
    """Strong components of a graph with cycles, and how many nodes each node leads to."""
    return reachable_counts(_cycles(spark, sf))


_CALLS = """SELECT -l_suppkey AS src, l_partkey AS dst, l_orderkey * 8 + l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 50
  UNION ALL SELECT l_partkey, -l_suppkey, l_orderkey * 8 + l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 2"""


def _tree_sql(depth: int) -> str:
    """Calls and first calls of each level in turn."""
    ctes = [f"e AS ({_CALLS})", "f0 AS (SELECT DISTINCT -s_suppkey AS start, -s_suppkey AS node, []::BIGINT[] AS place FROM supplier)"]
    for d in range(1, depth + 1):
        ctes.append(f"c{d} AS (SELECT start, src, dst, list_append(place, pos) AS place FROM f{d - 1} JOIN e ON src = node)")
        seen = " UNION ALL ".join(f"SELECT start, node FROM f{k}" for k in range(d))
        ctes.append(f"f{d} AS (SELECT c.start, c.dst AS node, min(c.place) AS place FROM c{d} c LEFT JOIN ({seen}) s ON s.start = c.start AND s.node = c.dst WHERE s.node IS NULL GROUP BY 1, 2)")
    lines = " UNION ALL ".join(f"SELECT c.start, {d} AS depth, c.src, c.dst, c.place, f.node IS NULL AS again FROM c{d} c LEFT JOIN f{d} f ON f.start = c.start AND f.node = c.dst AND f.place = c.place" for d in range(1, depth + 1))
    return "WITH " + ", ".join(ctes) + f""" SELECT start, row_number() OVER (PARTITION BY start ORDER BY place, dst) AS line, repeat(' ', 2 * depth) || CASE WHEN dst < 0 THEN 'supplier ' || (-dst) ELSE 'part ' || dst END || CASE WHEN again THEN ' [above]' ELSE '' END AS text FROM ({lines})"""


@query(_tree_sql(4))
def call_tree_walk(spark, sf):
    """Callees below each supplier to a depth of four: each line below its caller, in the order of the calls."""
    rows = table(spark, sf, "lineitem")
    at = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at")
    down = rows.filter("l_returnflag = 'A' and l_quantity >= 50").select((-F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), at)
    up = rows.filter("l_returnflag = 'R' and l_quantity <= 2").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), at)
    starts = table(spark, sf, "supplier").select((-F.col("s_suppkey")).alias("node"))
    name = F.when(F.col("dst") < 0, F.concat(F.lit("supplier "), -F.col("dst"))).otherwise(F.concat(F.lit("part "), F.col("dst")))
    tree = call_tree(starts, down.unionByName(up), 4)
    text = F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), name, F.when(F.col("again"), " [above]").otherwise(""))
    return tree.select("start", "line", text.alias("text")).orderBy("start", "line")
