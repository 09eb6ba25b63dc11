"""Queries by operator group, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import reach
from ..operators.steps import exists, holds, position, same, step, test, wildcard
from ..sources.folders import dealt
from ..sources.trees import sales, table
from ..streaming import sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def kind(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("kind") == name)


def families(nodes: DataFrame) -> DataFrame:
    """The nodes dealt by parent, as their number needs it, for windows over siblings."""
    return dealt(nodes, nodes.count(), "tree_id", "parent_id")


@query("SELECT c_nationkey::BIGINT AS nation, count(*) AS customers FROM customer GROUP BY 1")
def path_child(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "nation"), n, "child", "customer", ("key",)).groupBy(F.col("ctx_key").alias("nation")).agg(F.count("*").alias("customers"))


@query("SELECT c_nationkey::BIGINT AS nation, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def path_descendant(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "nation"), n, "descendant", "order", ("key",)).groupBy(F.col("ctx_key").alias("nation")).agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders WHERE upper(o_orderpriority) = '1-URGENT'")
def path_parent(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "order").filter(same(F.col("attr"), "1-urgent")), n, "parent", None, ("key",)).select(F.col("ctx_key").alias("orderkey"), F.col("key").alias("custkey"))


@query("SELECT 'customer' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM orders")
def path_ancestor(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "order"), n, "ancestor").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT a.o_orderkey AS orderkey, count(*) AS later FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey > a.o_orderkey GROUP BY 1")
def path_following_sibling(spark, sf):
    # how many follow is a place among siblings; no pairs are needed
    n = families(kind(sales(spark, sf), "order"))
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id").rowsBetween(1, Window.unboundedFollowing)
    return n.select(F.col("key").alias("orderkey"), F.count(F.lit(1)).over(w).alias("later")).filter("later > 0")


@query("SELECT a.o_orderkey AS orderkey, min(b.o_orderkey) AS earliest FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey GROUP BY 1")
def path_preceding_sibling(spark, sf):
    n = families(kind(sales(spark, sf), "order"))
    w = Window.partitionBy("tree_id", "parent_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.select(F.col("key").alias("orderkey"), F.min("key").over(w).alias("earliest")).filter("earliest is not null")


@query("""SELECT c.c_custkey AS custkey, (SELECT count(*) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey > c.c_custkey)
  + (SELECT count(*) FROM orders JOIN customer d ON o_custkey = d.c_custkey WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey >= c.c_custkey) AS n
  FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND ((SELECT count(*) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey > c.c_custkey) > 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey))""")
def path_following(spark, sf):
    # pre-order numbers tell how many nodes follow within the parent's subtree
    n = sales(spark, sf)
    ends = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("sub_end").alias("parent_end"))
    rows = kind(n, "customer").filter(same(F.col("attr"), "building")).join(ends, ["tree_id", "parent_id"])
    return rows.select(F.col("key").alias("custkey"), (F.col("parent_end") - F.col("node_id")).alias("n")).filter("n > 0")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def path_exists(spark, sf):
    n = sales(spark, sf)
    urgent = kind(n, "order").filter(same(F.col("attr"), "1-URGENT"))
    return exists(kind(n, "customer").filter(same(F.col("attr"), "building")), urgent, "descendant").select(F.col("key").alias("custkey"))


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def path_not_exists(spark, sf):
    n = sales(spark, sf)
    return exists(kind(n, "customer"), kind(n, "order").filter(same(F.col("attr"), "1-URGENT")), "child", negate=True).select(F.col("key").alias("custkey"))


def _places(order: str, where: str) -> str:
    return f"SELECT nation, orderkey FROM (SELECT c_nationkey::BIGINT AS nation, o_orderkey AS orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {order}) AS r FROM orders JOIN customer ON o_custkey = c_custkey) WHERE {where}"


@query(_places("c_custkey, o_orderkey", "r = 3"))
def pos_n(spark, sf):
    return position(kind(sales(spark, sf), "order"), 3, ["tree_id"]).select(F.col("tree_id").alias("nation"), F.col("key").alias("orderkey"))


@query(_places("c_custkey DESC, o_orderkey DESC", "r = 1"))
def pos_last(spark, sf):
    # the last one is a maximum, combined before the shuffle
    return kind(sales(spark, sf), "order").groupBy(F.col("tree_id").alias("nation")).agg(F.max_by("key", "node_id").alias("orderkey"))


@query("SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey FROM orders GROUP BY 1")
def pos_per_context(spark, sf):
    return position(kind(sales(spark, sf), "order"), 1, ["tree_id", "parent_id"], True).select(F.col("c").alias("custkey"), F.col("key").alias("orderkey"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
def sibling_ordinal(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("ordinal"), F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("SELECT conv_id, turn, '/conversation[' || conv_id || ']/' || role || '[' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || ']' AS path FROM conversations")
def node_path(spark, sf):
    at = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.format_string("/conversation[%d]/%s[%d]", "conv_id", "role", at).alias("path"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE NOT (upper(o_orderstatus) = 'F' OR contains(upper(o_orderpriority), 'LOW')) AND upper(o_orderpriority) < '3'")
def pred_and_or_not(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter(~(same(F.col("o_orderstatus"), "f") | holds(F.col("o_orderpriority"), "low")) & test(F.upper("o_orderpriority") < "3")).select(F.col("o_orderkey").alias("orderkey"))


@query("SELECT p_partkey AS partkey, p_name AS name FROM part WHERE p_name ILIKE '%a%e_'")
def find_wildcard(spark, sf):
    return table(spark, sf, "part").filter(wildcard(F.col("p_name"), "*a*e?")).select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("name")).orderBy("name", "partkey")


@query("SELECT 'customer' AS kind, c_name AS name FROM customer WHERE c_name ILIKE '%7' UNION ALL SELECT 'supplier', s_name FROM supplier WHERE s_name ILIKE '%7'")
def find_members(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return a.unionByName(b).filter(wildcard(F.col("name"), "*7"))


@query("SELECT doc_id, contains(upper(text), 'LICENSE') AS by_text, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS by_regex FROM documents WHERE contains(upper(text), 'LICENSE') OR regexp_matches(text, '[0-9]{3}-[0-9]{4}')")
def find_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", holds(F.col("text"), "license").alias("by_text"), test(F.col("text").rlike("[0-9]{3}-[0-9]{4}")).alias("by_regex"))
    return d.filter("by_text or by_regex")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
  h AS (SELECT doc_id, no FROM l WHERE contains(upper(line), 'LICENSE'))
  SELECT h.doc_id, h.no::BIGINT AS hit, l.no::BIGINT AS line_no, md5(l.line) AS line FROM h JOIN l ON l.doc_id = h.doc_id AND l.no BETWEEN h.no - 2 AND h.no + 2""")
def context_lines(spark, sf):
    d = table(spark, sf, "documents").filter(holds(F.col("text"), "license"))  # nothing else has a hit
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    hits = lines.filter(holds(F.col("line"), "license")).select("doc_id", F.col("line_no").alias("hit"))
    near = hits.select("doc_id", "hit", F.explode(F.sequence(F.col("hit") - 2, F.col("hit") + 2)).alias("line_no"))
    return near.join(lines, ["doc_id", "line_no"]).select("doc_id", "hit", "line_no", F.md5("line").alias("line"))


@query("SELECT l_partkey AS partkey, count(*) AS refs, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def impact_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("partkey")).agg(F.count("*").alias("refs"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT o_custkey AS custkey, min(o_orderkey) AS orderkey FROM orders GROUP BY 1")
def first_per_group(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min_by("o_orderkey", "o_orderkey").alias("orderkey"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1")
def distinct_tags(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tags"))


_CHAIN = "SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders"


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_CHAIN}) WHERE dst IS NOT NULL), s AS (SELECT min(o_orderkey) AS node FROM orders GROUP BY o_custkey),
  r(start, node, depth) AS (SELECT node, node, 0 FROM s UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 5)
  SELECT start, node, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1, 2""")
def callees_depth5(spark, sf):
    o = table(spark, sf, "orders")
    o = dealt(o, o.count(), "o_custkey")
    edges = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).filter("dst is not null")
    return reach(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("node")), edges, 5)


@query("""SELECT user_id, 'both' AS what FROM (SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')
  UNION ALL SELECT user_id, 'viewed' FROM (SELECT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')
  UNION ALL SELECT user_id, 'bought' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'view')""")
def flow_sets(spark, sf):
    e = table(spark, sf, "events")
    f = e.groupBy("user_id").agg(F.max((F.col("event_type") == "view").cast("int")).alias("r"), F.max((F.col("event_type") == "purchase").cast("int")).alias("w"))
    what = F.when(F.expr("r = 1 and w = 1"), "both").when(F.expr("r = 1"), "viewed").when(F.expr("w = 1"), "bought")
    return f.select("user_id", what.alias("what")).filter("what is not null")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_tracking(spark, sf):
    active = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).join(active, "custkey", "left_anti")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_eviction(spark, sf):
    return sessions(table(spark, sf, "events")).select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), "n")


@query("SELECT p_partkey AS partkey, starts_with(upper(p_type), 'S') AS starts, length(p_name)::INT AS n, translate(p_name, 'abc', 'xyz') AS swapped, concat_ws('.', p_brand, p_type) AS signature FROM part")
def scalar_functions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("partkey"), test(F.startswith(F.upper("p_type"), F.lit("S"))).alias("starts"), F.length("p_name").alias("n"), F.translate("p_name", "abc", "xyz").alias("swapped"), F.concat_ws(".", "p_brand", "p_type").alias("signature"))
