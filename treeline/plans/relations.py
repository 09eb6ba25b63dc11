"""Type edges, sets, neighbours, control flow and write contexts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import holds_sql, named
from ..operators.flow import control_flow
from ..operators.graph import members_of, reach
from ..operators.steps import test
from ..sources.trees import sales, table
from .catalogue import query


def _owners(spark, sf):
    """region > nation > customer as edges of one numbering: (src, dst, name of dst)."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    top = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_name").alias("name"))
    return top.unionByName(customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.col("c_name").alias("name")))


_OWNERS = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_name AS name FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_name FROM customer"


@query(f"""WITH RECURSIVE e AS ({_OWNERS}), r(base, derived, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region
  UNION SELECT base, dst, depth + 1 FROM r JOIN e ON src = derived) SELECT base, derived, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1, 2""")
def derived_closure(spark, sf):
    starts = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return reach(starts, _owners(spark, sf)).select(F.col("start").alias("base"), F.col("node").alias("derived"), "depth")


@query(f"""WITH e AS ({_OWNERS}), k AS (SELECT x.src AS base, y.dst AS derived FROM e x JOIN e y ON y.src = x.dst UNION SELECT src, dst FROM e),
  m AS (SELECT 'c' || o_custkey AS owner, o_orderpriority AS member FROM orders UNION SELECT 'n' || s_nationkey, '1-URGENT' FROM supplier)
  SELECT DISTINCT base, derived, b.member FROM k JOIN m a ON a.owner = base JOIN m b ON b.owner = derived AND a.member = b.member""")
def overrides(spark, sf):
    members = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("owner"), F.col("o_orderpriority").alias("member"))
    members = members.unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), F.lit("1-URGENT").alias("member")))
    edges = _owners(spark, sf)
    derived = reach(edges.select(F.col("src").alias("node")), edges)
    return members_of(derived.select(F.col("start").alias("base"), F.col("node").alias("derived")), members)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'view'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id"))


@query("SELECT l_suppkey AS suppkey, l_partkey AS part, count(*) AS times FROM lineitem GROUP BY 1, 2")
def adjacency_map(spark, sf):
    """Edges with their weights, a row each: a node may have any number."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.col("l_partkey").alias("part")).agg(F.count("*").alias("times"))


@query("""SELECT conv_id, turn, role, coalesce(lag(role) OVER w, '') AS earlier, coalesce(lead(role) OVER w, '') AS later FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def nav_lead_lag(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = {"earlier": F.coalesce(F.lag("role").over(w), F.lit("")), "later": F.coalesce(F.lead("role").over(w), F.lit(""))}
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", *[c.alias(k) for k, c in near.items()])


@query("""SELECT c_nationkey::BIGINT AS nation, c_custkey AS custkey, 'customer ' || c_custkey || coalesce(' [' || below || ']', '') AS dump FROM customer
  LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS below FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def subtree_dump(spark, sf):
    """A line for each subtree of the second level, with what is below it."""
    n = sales(spark, sf)
    keys = F.transform(F.sort_array(F.collect_list(F.struct("node_id", "key"))), lambda x: x["key"].cast("string"))
    below = n.filter("kind = 'order'").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.array_join(keys, " ").alias("below"))
    tops = n.filter("kind = 'customer'").join(below, ["tree_id", "node_id"], "left")
    line = F.concat(F.lit("customer "), F.col("key"), F.coalesce(F.concat(F.lit(" ["), "below", F.lit("]")), F.lit("")))
    return tops.select(F.col("tree_id").alias("nation"), F.col("key").alias("custkey"), line.alias("dump"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS exits, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type IN ('purchase', 'error')), '') AS kinds,
  CASE WHEN arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') THEN 'no' ELSE 'yes' END AS end_reachable FROM events GROUP BY 1""")
def control_flow_summary(spark, sf):
    rows = control_flow(table(spark, sf, "events"), "user_id", ("ts", "event_id"), "event_type", returns=("purchase",), others=("error",))
    return rows.withColumn("end_reachable", F.when(F.col("end_reachable"), "yes").otherwise("no"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'assignment' WHEN event_type = 'click' THEN 'increment' ELSE 'read' END AS context FROM events""")
def write_context(spark, sf):
    kind = F.col("event_type")
    context = F.when(test(kind == "purchase"), "assignment").when(test(kind == "click"), "increment").otherwise("read")
    return table(spark, sf, "events").select("event_id", context.alias("context"))


@query("SELECT o_orderkey AS orderkey, CASE o_orderstatus WHEN 'O' THEN 'public' WHEN 'F' THEN 'private' ELSE 'unknown' END AS access FROM orders")
def accessibility(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), named(F.col("o_orderstatus"), {"O": "public", "F": "private"}).alias("access"))


@query(r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bselect\b.*\bfrom\b|\binsert\s+into\b|\bupdate\b.*\bset\b|\bdelete\s+from\b', 's')""")
def sql_strings(spark, sf):
    return table(spark, sf, "documents").filter(holds_sql(F.col("text"))).select("doc_id")
