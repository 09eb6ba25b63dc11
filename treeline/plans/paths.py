"""Paths of several steps, attributes, subtrees and statements of the sales tree, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.paths import At, Has, Step, kth_siblings, limited, lines, node_paths, path
from ..operators.steps import attribute, attributes, differs, holds, is_true, same, step, wildcard
from ..sources.trees import FAMILIES, sales, table
from .catalogue import kind, query

#: The node table in SQL.
_NODES = """WITH n AS (SELECT n_nationkey::BIGINT AS t, NULL::BIGINT AS c, NULL::BIGINT AS o, 'nation' AS kind, n_nationkey::BIGINT AS key, n_name AS attr, n_name AS name, NULL::VARCHAR AS status, 0 AS depth FROM nation
  UNION ALL SELECT c_nationkey, c_custkey, NULL, 'customer', c_custkey, c_mktsegment, c_name, NULL, 1 FROM customer
  UNION ALL SELECT c_nationkey, o_custkey, o_orderkey, 'order', o_orderkey, o_orderpriority, NULL, o_orderstatus, 2 FROM orders JOIN customer ON c_custkey = o_custkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c NULLS FIRST, o NULLS FIRST) - 1 AS node_id FROM n) """


def urgent(negate: bool = False) -> Has:
    return Has((Step("child", "order", (same(F.col("attr"), "1-urgent"),)),), negate)


@query("SELECT c_custkey AS custkey, c_custkey AS self FROM customer")
def path_self(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "customer"), n, "self", None, ("key",)).select(F.col("ctx_key").alias("custkey"), F.col("key").alias("self"))


@query("SELECT unnest(['nation', 'customer', 'order']) AS kind, count(*) AS n FROM orders GROUP BY 1")
def path_ancestor_or_self(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "order"), n, "ancestor-or-self").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def path_composed(spark, sf):
    """nation//customer[@attr='building'][order[@attr='1-urgent']]/order[last()]"""
    n = sales(spark, sf)
    steps = [Step("descendant", "customer", (same(F.col("attr"), "building"), urgent())), Step("child", "order", (At(1, last=True),))]
    return path(kind(n, "nation"), n, steps).select(F.col("c").alias("custkey"), F.col("key").alias("orderkey"))


@query("""SELECT c_nationkey::BIGINT AS nation, c_custkey AS custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer
  WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) WHERE r = 2""")
def path_not_then_position(spark, sf):
    """nation/customer[not(order[@attr='1-urgent'])][2]"""
    n = sales(spark, sf)
    rows = path(kind(n, "nation"), n, [Step("child", "customer", (urgent(negate=True), At(2)))])
    return rows.select(F.col("tree_id").alias("nation"), F.col("key").alias("custkey"))


@query("SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def path_up_and_down(spark, sf):
    """order[@status='p']/../order[1], distinct after each step"""
    n = sales(spark, sf)
    rows = path(kind(n, "order").filter(same(F.col("status"), "p")), n, [Step("parent"), Step("child", "order", (At(1),))], distinct=True)
    return rows.select(F.col("c").alias("custkey"), F.col("key").alias("orderkey"))


@query("SELECT o_custkey AS custkey, count(*) FILTER (o_orderstatus = 'P') AS times FROM orders GROUP BY 1 HAVING times > 0")
def path_multiset(spark, sf):
    """The same without distinct: the first order once for each context."""
    n = sales(spark, sf)
    rows = path(kind(n, "order").filter(same(F.col("status"), "p")), n, [Step("parent"), Step("child", "order", (At(1),))])
    return rows.groupBy(F.col("c").alias("custkey")).agg(F.count("*").alias("times"))


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders")
def path_nearest_ancestor(spark, sf):
    """order/ancestor[1]"""
    n = sales(spark, sf)
    rows = path(kind(n, "order").withColumn("orderkey", F.col("key")), n, [Step("ancestor", None, (At(1),))], carry=("orderkey",))
    return rows.select("orderkey", F.col("key").alias("custkey"))


@query("SELECT a.o_custkey AS custkey, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW' GROUP BY 1")
def path_siblings_after(spark, sf):
    """order[@attr='1-urgent']/following-sibling::order[@attr='5-low']"""
    n = sales(spark, sf)
    rows = path(kind(n, "order").filter(same(F.col("attr"), "1-urgent")), n, [Step("following-sibling", "order", (same(F.col("attr"), "5-low"),))])
    return rows.groupBy(F.col("c").alias("custkey")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 3")
def path_count(spark, sf):
    """customer[count(order) > 3]"""
    n = sales(spark, sf)
    many = step(kind(n, "customer"), n, "child", "order", ("key",)).groupBy(F.col("ctx_key").alias("custkey")).agg(F.count("*").alias("orders"))
    return many.filter("orders > 3")


@query(_NODES + "SELECT kind, key FROM k WHERE status <> 'F'")
def pred_differs(spark, sf):
    """[@status != 'f']: nodes without a status are not found."""
    return sales(spark, sf).filter(differs(F.col("status"), "f")).select("kind", "key")


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice > 100000")
def pred_boolean(spark, sf):
    n = kind(sales(spark, sf), "order").withColumn("large", F.when(F.col("value") > 100000, "True").otherwise("False"))
    return n.filter(is_true(F.col("large"))).select(F.col("key").alias("orderkey"))


@query(_NODES + "SELECT kind, key, name, attr, status, NULL::VARCHAR AS colour FROM k")
def attr_projection(spark, sf):
    n = sales(spark, sf)
    return n.select("kind", "key", *[attribute(n, a).alias(a) for a in ("name", "attr", "status", "colour")])


@query(_NODES + "SELECT t AS nation, node_id, concat_ws(',', CASE WHEN attr IS NOT NULL THEN 'attr=' || attr END, CASE WHEN name IS NOT NULL THEN 'name=' || name END, CASE WHEN status IS NOT NULL THEN 'status=' || status END) AS attrs FROM k WHERE depth >= 1")
def dump_attributes(spark, sf):
    n = limited(sales(spark, sf), 3, base=1)
    text = F.array_join(F.transform(F.sort_array(F.map_entries(attributes(n, "attr", "name", "status"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return n.select(F.col("tree_id").alias("nation"), "node_id", text.alias("attrs"))


@query(_NODES + """SELECT a.key AS root, b.depth - a.depth AS level, b.node_id, b.kind FROM k a JOIN k b ON b.t = a.t AND (b.c = a.c) AND b.depth - a.depth BETWEEN 0 AND 1 WHERE a.kind = 'customer' AND a.attr = 'MACHINERY'""")
def subtree_to_depth(spark, sf):
    """Subtrees of chosen roots to a relative depth, as rows."""
    n = sales(spark, sf)
    roots = kind(n, "customer").filter(same(F.col("attr"), "machinery"))
    rows = step(roots, n, "descendant-or-self", None, ("key", "depth")).withColumn("level", F.col("depth") - F.col("ctx_depth")).filter("level <= 1")
    return rows.select(F.col("ctx_key").alias("root"), "level", "node_id", "kind")


@query(_NODES + "SELECT t AS nation, node_id, repeat(' ', 2 * depth) || kind || ' ' || key AS line FROM k")
def tree_lines(spark, sf):
    label = F.concat_ws(" ", "kind", "key")
    return lines(sales(spark, sf), label).select(F.col("tree_id").alias("nation"), "node_id", "line")


@query(_NODES + """, s AS (SELECT *, row_number() OVER (PARTITION BY t, c, kind ORDER BY node_id) AS in_c, row_number() OVER (PARTITION BY t, kind ORDER BY node_id) AS in_t FROM k)
  SELECT o.key AS orderkey, '/nation[' || o.t || ']/customer[' || c.in_t || ']/order[' || o.in_c || ']' AS path FROM s o JOIN s c ON c.t = o.t AND c.c = o.c AND c.kind = 'customer' WHERE o.kind = 'order'""")
def node_path_full(spark, sf):
    n = sales(spark, sf)
    at = F.when(F.col("kind") == "nation", F.col("key")).otherwise(F.col("ordinal"))
    return node_paths(kind(n, "order"), n, F.concat(F.col("kind"), F.lit("["), at, F.lit("]"))).select(F.col("key").alias("orderkey"), "path")


@query(_NODES + """, h AS (SELECT * FROM k WHERE kind = 'order' AND contains(upper(attr), 'URGENT'))
  SELECT t AS nation, key AS orderkey, 'stmt-' || row_number() OVER (PARTITION BY t ORDER BY node_id) AS id, 2 AS depth, '/' || t || '/' || c || '/' || o AS path, CASE WHEN status = 'P' THEN 'open' ELSE 'done' END AS tag FROM h""")
def find_statements(spark, sf):
    """Statements by text, with id, depth, path and tag."""
    n = sales(spark, sf)
    hits = kind(n, "order").filter(holds(F.col("attr"), "urgent"))
    hits = hits.withColumn("id", F.format_string("stmt-%d", F.row_number().over(Window.partitionBy("tree_id").orderBy("node_id"))))
    rows = node_paths(hits, n, F.col("key").cast("string"))
    return rows.select(F.col("tree_id").alias("nation"), F.col("key").alias("orderkey"), "id", "depth", "path", F.when(same(F.col("status"), "p"), "open").otherwise("done").alias("tag"))


@query("SELECT o_orderkey AS orderkey, lag(o_orderkey, 3) OVER w AS earlier, lead(o_orderkey, 3) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def nav_kth_sibling(spark, sf):
    return kth_siblings(kind(sales(spark, sf), "order"), "key", 3).select(F.col("key").alias("orderkey"), "earlier", "later")


@query(_NODES + "SELECT kind, kind IN ('nation', 'customer') AS is_type, kind = 'customer' AS is_member, kind = 'order' AS is_statement, count(*) AS n FROM k GROUP BY ALL")
def kind_families(spark, sf):
    flags = [F.col("kind").isin(*kinds).alias(f"is_{f}") for f, kinds in FAMILIES.items()]
    return sales(spark, sf).select("kind", *flags).groupBy("kind", *[f"is_{f}" for f in FAMILIES]).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_name ILIKE '%7' AND o_orderpriority ILIKE '%urgent'")
def find_by_owner(spark, sf):
    """Members by their own name and that of their owner, ordered by both."""
    n = sales(spark, sf)
    owners = kind(n, "customer").filter(wildcard(F.col("name"), "*7"))
    rows = step(owners, kind(n, "order").filter(wildcard(F.col("attr"), "*urgent")), "child", None, ("key",))
    return rows.select(F.col("ctx_key").alias("custkey"), F.col("key").alias("orderkey")).orderBy("custkey", "orderkey")


@query(_NODES + "SELECT DISTINCT kind, key FROM k WHERE upper(name) LIKE '%1' OR upper(attr) LIKE '%MACHINERY'")
def get_symbols(spark, sf):
    """Union of several searches, each node once."""
    n = sales(spark, sf)
    found = n.filter(wildcard(F.col("name"), "*1")).unionByName(n.filter(wildcard(F.col("attr"), "*machinery"))).unionByName(n.filter(wildcard(F.col("attr"), "*1")))
    return found.dropDuplicates(["tree_id", "node_id"]).select("kind", "key")


@query("SELECT o_orderkey AS orderkey, c_name AS owner, n_name || '.' || c_name AS label, c_acctbal AS balance FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def node_enriched(spark, sf):
    """Nodes with what is known of their symbols, and the label of the enclosing member."""
    rows = kind(sales(spark, sf), "order").filter(same(F.col("status"), "p"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), F.col("c_name").alias("owner"), F.col("c_acctbal").alias("balance"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tree_id"), "n_name")
    rows = rows.join(customer, "c", "left").join(nation, "tree_id", "left")
    return rows.select(F.col("key").alias("orderkey"), "owner", F.concat_ws(".", "n_name", "owner").alias("label"), "balance")


@query("SELECT DISTINCT c_custkey AS custkey, n_name AS document FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'")
def symbol_document(spark, sf):
    """From a symbol to its node to its document."""
    n = sales(spark, sf)
    nodes = path(kind(n, "order").filter(same(F.col("attr"), "1-urgent")), n, [Step("parent")], distinct=True)
    document = kind(n, "nation").select("tree_id", F.col("name").alias("document"))
    return nodes.join(document, "tree_id").select(F.col("key").alias("custkey"), "document")


@query("SELECT c_custkey AS custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer")
def accessor_flags(spark, sf):
    """Whether a node has a child of each of two sorts, in one pass over the children."""
    n = sales(spark, sf)
    flag = lambda s: F.max(same(F.col("status"), s))
    below = kind(n, "order").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(flag("o").alias("has_open"), flag("p").alias("has_pending"))
    rows = kind(n, "customer").join(below, ["tree_id", "node_id"], "left")
    return rows.select(F.col("key").alias("custkey"), F.coalesce("has_open", F.lit(False)).alias("has_open"), F.coalesce("has_pending", F.lit(False)).alias("has_pending"))
