"""Regions, nearest nodes, edits, markers, flow and scalar queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import after, before, is_identifier, normalize_space, renamed, shortened, whole
from ..operators import edits
from ..operators.graph import reach
from ..operators.paths import limited
from ..operators.spans import innermost, inside, nearest, overlaps
from ..operators.steps import exists, position, same, step, wildcard
from ..sources.folders import dealt
from ..sources.trees import sales, table
from ..streaming.markers import cleared, find, mark, unmark
from .catalogue import _CHAIN, kind, query

_TREE = """WITH n AS (SELECT n_nationkey::BIGINT AS t, NULL::BIGINT AS c, NULL::BIGINT AS o FROM nation UNION ALL SELECT c_nationkey, c_custkey, NULL FROM customer
  UNION ALL SELECT c_nationkey, o_custkey, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c NULLS FIRST, o NULLS FIRST) - 1 AS node_id,
    CASE WHEN c IS NULL THEN count(*) OVER (PARTITION BY t) WHEN o IS NULL THEN count(*) OVER (PARTITION BY t, c) ELSE 1 END AS size FROM n) """


@query(_TREE + "SELECT t AS nation, node_id, node_id + size - 1 AS sub_end FROM k WHERE node_id >= 20 AND node_id + size - 1 <= 200")
def region_contains(spark, sf):
    return inside(sales(spark, sf), 20, 200).select(F.col("tree_id").alias("nation"), "node_id", "sub_end")


@query(_TREE + "SELECT t AS nation, max(node_id) AS node_id FROM k WHERE node_id <= 150 AND node_id + size - 1 >= 150 GROUP BY t")
def innermost_at_point(spark, sf):
    return innermost(sales(spark, sf), 150).select(F.col("tree_id").alias("nation"), "node_id")


@query("SELECT o_orderkey AS orderkey, o_custkey AS custkey FROM orders")
def enclosing_nearest(spark, sf):
    n = sales(spark, sf)
    rows = nearest(kind(n, "order"), n, "customer")
    owner = kind(n, "customer").select("tree_id", F.col("node_id").alias("found"), F.col("key").alias("custkey"))
    return rows.join(owner, ["tree_id", "found"]).select(F.col("key").alias("orderkey"), "custkey")


@query("""WITH s AS (SELECT o_custkey AS custkey, o_orderkey AS id, epoch_us(o_orderdate) // 86400000000 AS f, epoch_us(max(l_shipdate)) // 86400000000 AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, o_orderdate)
  SELECT x.custkey, x.id AS a, y.id AS b FROM s x JOIN s y ON x.custkey = y.custkey AND x.id < y.id AND x.f <= y.l AND y.f <= x.l WHERE x.f <= x.l AND y.f <= y.l""")
def span_overlaps(spark, sf):
    day = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 86400000000)
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("ship"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("id"), "o_orderdate")
    s = o.join(ship, "id").select("custkey", "id", day(F.col("o_orderdate")).alias("first"), day(F.col("ship")).alias("last"))
    return overlaps(s, s, "custkey", 64).filter("a < b")


@query("""SELECT n_nationkey::BIGINT AS nation, NULL::BIGINT AS custkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS children, false AS truncated FROM nation
  UNION ALL SELECT c_nationkey, c_custkey, count(o_orderkey), count(o_orderkey) > 0 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def depth_limited(spark, sf):
    return limited(sales(spark, sf), 1).select(F.col("tree_id").alias("nation"), F.col("c").alias("custkey"), "children", "truncated")


@query("""SELECT c.c_custkey AS custkey, (SELECT count(*) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey < c.c_custkey)
  + (SELECT count(*) FROM orders JOIN customer d ON o_custkey = d.c_custkey WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey < c.c_custkey) AS n
  FROM customer c WHERE c.c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_custkey < c.c_custkey)""")
def path_preceding(spark, sf):
    rows = kind(sales(spark, sf), "customer").filter(same(F.col("attr"), "building"))
    return rows.select(F.col("key").alias("custkey"), (F.col("node_id") - F.col("parent_id") - 1).alias("n")).filter("n > 0")


@query("SELECT c_custkey AS custkey, count(o_orderkey) + 1 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def path_descendant_or_self(spark, sf):
    n = sales(spark, sf)
    return step(kind(n, "customer"), n, "descendant-or-self", None, ("key",)).groupBy(F.col("ctx_key").alias("custkey")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'MACHINERY' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")
def path_exists_or(spark, sf):
    n = sales(spark, sf)
    c = kind(n, "customer")
    low = exists(c, kind(n, "order").filter(same(F.col("attr"), "5-low")), "child").select("tree_id", "node_id", F.lit(True).alias("hit"))
    return c.join(low, ["tree_id", "node_id"], "left").filter(F.coalesce("hit", F.lit(False)) | same(F.col("attr"), "machinery")).select(F.col("key").alias("custkey"))


@query("SELECT o_orderkey AS orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
def nested_filter(spark, sf):
    n = sales(spark, sf)
    return exists(kind(n, "order"), kind(n, "customer").filter(same(F.col("attr"), "building")), "ancestor", negate=True).select(F.col("key").alias("orderkey"))


@query("SELECT custkey, orderkey FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 3")
def pos_last_minus(spark, sf):
    return position(kind(sales(spark, sf), "order"), 3, ["tree_id", "parent_id"], True).select(F.col("c").alias("custkey"), F.col("key").alias("orderkey"))


@query("""SELECT nation, orderkey FROM (SELECT nation, orderkey, row_number() OVER (PARTITION BY nation ORDER BY custkey, orderkey) AS q FROM
  (SELECT c_nationkey::BIGINT AS nation, c_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM orders JOIN customer ON c_custkey = o_custkey) WHERE r = 2) WHERE q = 3""")
def pos_chain(spark, sf):
    second = position(kind(sales(spark, sf), "order"), 2, ["tree_id", "parent_id"])
    return position(second, 3, ["tree_id"]).select(F.col("tree_id").alias("nation"), F.col("key").alias("orderkey"))


@query(f"""WITH RECURSIVE e AS (SELECT dst AS src, src AS dst FROM ({_CHAIN}) WHERE dst IS NOT NULL), s AS (SELECT max(o_orderkey) AS node FROM orders GROUP BY o_custkey),
  r(start, node, depth) AS (SELECT node, node, 0 FROM s UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 5)
  SELECT start, node, min(depth)::INT AS depth FROM r WHERE depth > 0 GROUP BY 1, 2""")
def callers_depth5(spark, sf):
    o = table(spark, sf, "orders")
    o = dealt(o, o.count(), "o_custkey")
    back = o.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).filter("dst is not null")
    return reach(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("node")), back, 5)


@query("SELECT l_partkey AS partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS nth, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem")
def refs_by_symbol(spark, sf):
    """References in order, as rows: a symbol may have any number."""
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"), F.row_number().over(w).alias("nth"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))


@query("SELECT user_id, CASE event_type WHEN 'view' THEN 'read' ELSE 'write' END AS access, event_id FROM events WHERE event_type IN ('view', 'purchase')")
def flow_locations(spark, sf):
    """Locations of reads and writes, as rows."""
    access = F.when(F.col("event_type") == "view", "read").otherwise("write")
    return table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase")).select("user_id", access.alias("access"), "event_id")


@query("""WITH k AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events)
  SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS write, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type <> 'purchase'), '') AS needs FROM k GROUP BY user_id, g HAVING count(*) FILTER (event_type = 'purchase') > 0""")
def flow_dependencies(spark, sf):
    is_write = F.col("event_type") == "purchase"
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    k = table(spark, sf, "events").withColumn("g", F.coalesce(F.sum(is_write.cast("int")).over(w), F.lit(0)))
    needs = F.array_join(F.sort_array(F.collect_set(F.when(~is_write, F.col("event_type")))), ",")
    return k.groupBy("user_id", "g").agg(F.max(F.when(is_write, F.col("event_id"))).alias("write"), needs.alias("needs")).filter("write is not null").drop("g")


@query("""WITH f AS (SELECT user_id, min((ts, event_id)) FILTER (event_type = 'view') AS r, min((ts, event_id)) FILTER (event_type = 'purchase') AS w FROM events GROUP BY 1)
  SELECT user_id, 'UnusedVariable' AS warning FROM f WHERE w IS NOT NULL AND r IS NULL UNION ALL SELECT user_id, 'UninitializedRead' FROM f WHERE r IS NOT NULL AND (w IS NULL OR r < w)""")
def flow_warnings(spark, sf):
    first = lambda kind_: F.min(F.when(F.col("event_type") == kind_, F.struct("ts", "event_id")))
    f = table(spark, sf, "events").groupBy("user_id").agg(first("view").alias("r"), first("purchase").alias("w"))
    warning = F.when(F.expr("w is not null and r is null"), "UnusedVariable").when(F.expr("r is not null and (w is null or r < w)"), "UninitializedRead")
    return f.select("user_id", warning.alias("warning")).filter("warning is not null")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\bof\b'))::BIGINT AS n_edits, md5(regexp_replace(text, '\bof\b', 'von', 'g')) AS text FROM documents WHERE regexp_matches(text, '\bof\b')")
def edit_rename(spark, sf):
    d = table(spark, sf, "documents").withColumn("n_edits", F.regexp_count("text", F.lit(whole("of"))).cast("long")).filter("n_edits > 0")
    return d.select("doc_id", "n_edits", F.md5(renamed(F.col("text"), "of", "von")).alias("text"))


@query("""WITH b AS (SELECT conv_id, turn, 0 AS side, md5(text) AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, 'seen' FROM conversations WHERE role = 'user')
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, side) AS turn, text FROM b""")
def edit_insert(spark, sf):
    t = table(spark, sf, "conversations")
    rows = t.select("conv_id", "turn", F.md5("text").alias("text"))
    return edits.insert(rows, t.filter("role = 'user'").select("conv_id", "turn", F.lit("seen").alias("text")), "conv_id", "turn")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, role FROM conversations WHERE role <> 'user'")
def edit_remove(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return edits.remove(t, t.filter("role = 'user'"), "conv_id", "turn")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'reader' ELSE role END AS role FROM conversations")
def edit_replace(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return edits.replace(t, t.filter("role = 'user'").withColumn("role", F.lit("reader")), "conv_id", "turn", "role")


_MARKS = "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderpriority AS priority, 'mark-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS marker FROM orders WHERE o_orderstatus = 'P'"


@query(f"SELECT custkey, orderkey, marker FROM ({_MARKS}) WHERE priority <> '1-URGENT'")
def markers_lifecycle(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_orderstatus", "o_orderpriority")
    marks = mark(o.filter("o_orderstatus = 'P'"), "custkey", "orderkey", "open")
    urgent = find(marks, o.filter("o_orderpriority = '1-URGENT'"), "custkey", "orderkey")
    return find(unmark(marks, urgent, "custkey"), o, "custkey", "orderkey").select("custkey", "orderkey", "marker")


@query("SELECT o_custkey AS custkey, count(*) AS cleared FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def markers_cleared(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return cleared(mark(o, "custkey", "orderkey"), "custkey")


@query("SELECT source, lang, count(*) AS documents, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1, 2")
def workspace_status(spark, sf):
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_union_distinct(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase")).select("user_id").distinct()


@query("SELECT o_orderkey AS orderkey, o_orderpriority AS priority FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 20")
def top_k(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"))


@query(r"""SELECT p_partkey AS partkey, trim(regexp_replace(p_name || '  ' || p_type, '[ \t\n\r]+', ' ', 'g')) AS spaced,
  CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS pre, CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END AS post,
  CASE WHEN length(p_name) < 8 THEN p_name ELSE substr(p_name, 1, 8) || '...' END AS short, CASE WHEN regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]*$') AND p_type <> 'class' THEN 'yes' ELSE 'no' END AS identifier, substr(p_name, 2, 3) AS middle FROM part""")
def fn_strings(spark, sf):
    p = table(spark, sf, "part")
    brand, name = F.col("p_brand"), F.col("p_name")
    yes = F.when(is_identifier(F.col("p_type"), ("class",)), "yes").otherwise("no")
    return p.select(
        F.col("p_partkey").alias("partkey"), normalize_space(F.concat("p_name", F.lit("  "), "p_type")).alias("spaced"), before(brand, "#").alias("pre"), after(brand, "#").alias("post"),
        shortened(name, 8).alias("short"), yes.alias("identifier"), F.substring(name, 2, 3).alias("middle"),
    )


@query("SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE c_name ILIKE 'customer%1_' OR upper(c_mktsegment) = 'BUILDING'")
def path_type_or_name(spark, sf):
    return table(spark, sf, "customer").filter(wildcard(F.col("c_name"), "Customer*1?") | same(F.col("c_mktsegment"), "building")).select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
