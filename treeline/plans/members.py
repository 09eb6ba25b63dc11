"""Files, attributes of members, flow in regions, edits and diagnostics, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import added_after, after, as_task, before, modifiers, renamed, shortened, summary, unquoted, whole, wildcard_replaced
from ..operators.flow import region_sets
from ..operators.graph import call_tree
from ..operators.steps import edge_wildcard, holds, test
from ..sources.files import files, language, workspace
from ..sources.trees import table
from ..streaming.markers import mark
from .catalogue import _CHAIN, query


_FILES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS name, 'table' AS language, count(*) AS n_rows FROM {t}" for t in _FILES))
def workspace_files(spark, sf):
    """The tables of a workspace by name, each with the rows that are read from it; those that are absent are left out."""
    found = files(spark, sf, "*.parquet").select(F.regexp_extract("path", r"/([^/]+\.parquet)(/[^/]+)?$", 1).alias("name"), language(F.col("path"), {"parquet": "table"}).alias("language")).distinct()
    present = {r["name"] for r in found.filter(F.col("name").isin([f"{t}.parquet" for t in _FILES])).select("name").collect()}  # as many as tables
    counts = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("name", F.lit(f"{t}.parquet")) for t in _FILES if f"{t}.parquet" in present]
    rows = spark.createDataFrame([], "n_rows long, name string")  # a folder without tables has no rows
    for more in counts:
        rows = rows.unionByName(more)
    return found.join(rows, "name").select("name", "language", "n_rows")


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.(html|htm)$') THEN 'page' WHEN regexp_matches(lower(url), '\.(com|net|org)$') THEN 'site' ELSE 'unknown' END AS language FROM pages""")
def language_by_extension(spark, sf):
    names = {"html": "page", "htm": "page", "com": "site", "net": "site", "org": "site"}
    return table(spark, sf, "pages").select("page_id", language(F.col("url"), names).alias("language"))


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages WHERE starts_with(upper(url), 'HTTPS://M.'))")
def workspace_selector(spark, sf):
    return workspace(table(spark, sf, "pages").select("page_id", "url"), "page_id", "url", "https://m.")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ends_with(props, '9}')")
def diagnostics(spark, sf):
    """Diagnostics of files with a suffix, by file and line."""
    rows = table(spark, sf, "events").filter(test(F.col("event_type") == "error") & test(F.endswith("props", F.lit("9}"))))
    return rows.select("event_id", "user_id").orderBy(F.coalesce("user_id", F.lit(0)), F.coalesce("event_id", F.lit(0)))


@query("""SELECT p_partkey AS partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: CASE x WHEN 'red' THEN 'static' WHEN 'small' THEN 'abstract' ELSE x END), ' ') AS modifiers,
  list_contains(string_split(lower(p_name), ' '), 'red') AS is_static, CASE p_type WHEN 'SMALL' THEN 'void' ELSE p_type END AS returns, '"' || p_name || '"' AS literal, p_name AS literal_value,
  split_part(p_brand, '#', 1) AS left_text, '#' AS operator, split_part(p_brand, '#', 2) AS right_text, CASE p_type WHEN 'SMALL' THEN 'sub' ELSE 'function' END AS methodtype FROM part""")
def member_attributes(spark, sf):
    """Modifiers by their common names, returned type, literal, operands and kind of method."""
    names = {"red": "static", "small": "abstract"}
    tokens, none = F.split("p_name", " "), F.col("p_type") == "SMALL"
    literal = F.concat(F.lit('"'), "p_name", F.lit('"'))
    common = modifiers(tokens, names)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("partkey"), common.alias("modifiers"), F.array_contains(F.split(common, " "), "static").alias("is_static"),
        F.when(none, "void").otherwise(F.coalesce("p_type", F.lit("Object"))).alias("returns"), literal.alias("literal"), unquoted(literal).alias("literal_value"),
        before(F.col("p_brand"), "#").alias("left_text"), F.lit("#").alias("operator"), after(F.col("p_brand"), "#").alias("right_text"), F.when(none, "sub").otherwise("function").alias("methodtype"),
    )


@query("""SELECT p_partkey AS partkey, ends_with(upper(p_name), 'T') AS ends, true AS text, 'part' AS local_name, '' AS namespace, printf('%.2f', p_retailprice) AS price, length(p_name) > 9 AS long,
  CASE WHEN starts_with(p_brand, 'Brand#') THEN 'B' || substr(p_brand, 7) || '!' ELSE p_brand END AS renamed, CASE WHEN p_type = 'SMALL' THEN 'Task' ELSE 'Task<' || p_type || '>' END AS task FROM part""")
def scalar_more(spark, sf):
    """ends-with, text(), local-name, namespace-uri, format-number, a comparison after a function, wildcard replace, asynchronous types."""
    local = after(F.lit("t:part"), ":")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("partkey"), test(F.endswith(F.upper("p_name"), F.lit("T"))).alias("ends"), F.lit(True).alias("text"), local.alias("local_name"), F.lit("").alias("namespace"),
        F.regexp_replace(F.format_number("p_retailprice", 2), ",", "").alias("price"), test(F.length("p_name") > 9).alias("long"), wildcard_replaced(F.col("p_brand"), "Brand#*", "B*!").alias("renamed"), as_task(F.col("p_type"), "SMALL").alias("task"),
    )


@query("SELECT p_partkey AS partkey FROM part WHERE ends_with(upper(p_name), 'RING') OR contains(upper(p_type), 'CON') OR starts_with(upper(p_brand), 'BRAND#1')")
def find_edge_wildcard(spark, sf):
    """The second dialect's patterns: stars at the ends alone."""
    hit = edge_wildcard(F.col("p_name"), "*ring") | edge_wildcard(F.col("p_type"), "*con*") | edge_wildcard(F.col("p_brand"), "brand#1*")
    return table(spark, sf, "part").filter(hit).select(F.col("p_partkey").alias("partkey")).orderBy("p_partkey")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[ \t\n\r]+', ' ', 'g')) AS summary FROM pages")
def doc_summary(spark, sf):
    return table(spark, sf, "pages").select("page_id", summary(F.col("html"), "title").alias("summary"))


@query("SELECT l_orderkey AS orderkey, 'Order.' || l_orderkey || '(' || string_agg(l_returnflag || ' p' || l_partkey, ', ' ORDER BY l_linenumber, l_partkey, l_returnflag) || ')' AS signature FROM lineitem GROUP BY 1")
def signatures(spark, sf):
    """Signatures from ordered parameters; an order has a few lines."""
    parameters = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    text = F.array_join(F.transform(parameters, lambda p: F.concat(p["l_returnflag"], F.lit(" p"), p["l_partkey"])), ", ")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(text.alias("text"))
    return rows.select("orderkey", F.format_string("Order.%d(%s)", "orderkey", "text").alias("signature"))


@query("""SELECT conv_id, turn, role, row_number() OVER w - 1 AS index, count(*) OVER (PARTITION BY conv_id) AS count, lag(role) OVER w AS earlier, lead(role) OVER w AS later,
  CASE WHEN length(text) < 20 THEN text ELSE substr(text, 1, 20) || '...' END AS short FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def statement_context(spark, sf):
    """A statement's place in its block, the block's size, its neighbours and its text cut short."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", (F.row_number().over(w) - 1).alias("index"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("count"), F.lag("role").over(w).alias("earlier"), F.lead("role").over(w).alias("later"), shortened(F.col("text"), 20).alias("short"),
    )


@query("""WITH v AS (SELECT user_id AS var, event_id AS pos, event_type = 'purchase' AS w, event_id BETWEEN 1000 AND 3000 AS inside FROM events WHERE event_type IN ('view', 'purchase')),
  f AS (SELECT var, coalesce(bool_or(inside AND NOT w), false) AS read_inside, coalesce(bool_or(inside AND w), false) AS written_inside, coalesce(bool_or(NOT w AND pos < 1000), false) AS read_before, coalesce(bool_or(w AND pos < 1000), false) AS written_before,
    coalesce(bool_or(NOT w AND pos > 3000), false) AS read_after, min(pos) FILTER (inside AND NOT w) AS r, min(pos) FILTER (inside AND w) AS x FROM v GROUP BY 1)
  SELECT var, read_inside, written_inside, read_inside AND written_before AND (x IS NULL OR r < x) AS flows_in, written_inside AND read_after AS flows_out, written_inside AND NOT (read_before OR written_before) AS declared FROM f WHERE read_inside OR written_inside""")
def flow_region(spark, sf):
    """Variables of a region: read, written, flowing in and out, first written there."""
    accesses = table(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase"))
    accesses = accesses.select(F.col("user_id").alias("var"), F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("is_write"))
    return region_sets(accesses, 1000, 3000)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE regexp_matches(text, '\bof\b'))
  SELECT doc_id, no::BIGINT AS line_no, len(regexp_extract_all(line, '\bof\b'))::BIGINT AS n_edits, md5(line) AS before, md5(regexp_replace(line, '\bof\b', 'von', 'g')) AS after FROM l WHERE regexp_matches(line, '\bof\b')""")
def rename_edits(spark, sf):
    """Edits of each file, last line first, with the line before and after."""
    d = table(spark, sf, "documents").filter(F.col("text").rlike(whole("of")))
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("n_edits", F.regexp_count("line", F.lit(whole("of"))).cast("long")).filter("n_edits > 0")
    rows = rows.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "n_edits", F.md5("line").alias("before"), F.md5(renamed(F.col("line"), "of", "von")).alias("after"))
    return rows.orderBy("doc_id", F.desc("line_no"))


@query(r"""SELECT source, count(*) FILTER (regexp_matches(text, '\bof\b')) AS files, coalesce(sum(len(regexp_extract_all(text, '\bof\b'))), 0)::BIGINT AS edits, coalesce(bool_or(regexp_matches(text, '\bvon\b')), false) AS conflict FROM documents GROUP BY 1""")
def rename_impact(spark, sf):
    """Files and edits that a rename costs, and whether the new name is taken."""
    text = F.col("text")
    hits = F.regexp_count("text", F.lit(whole("of")))
    return table(spark, sf, "documents").groupBy("source").agg(
        F.count_if(hits > 0).alias("files"), F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("edits"), F.coalesce(F.max(text.rlike(whole("von"))), F.lit(False)).alias("conflict")
    )


@query("""SELECT doc_id, md5(CASE WHEN contains(text, chr(10)) THEN substr(text, 1, strpos(text, chr(10))) || 'added' || chr(10) || substr(text, strpos(text, chr(10)) + 1) ELSE text || 'added' || chr(10) END) AS text FROM documents""")
def edit_add_member(spark, sf):
    """A member put in after the first line."""
    return table(spark, sf, "documents").select("doc_id", F.md5(added_after(F.col("text"), "\n", "added\n")).alias("text"))


@query("""SELECT custkey, orderkey, marker FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, 'mark-' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS marker FROM orders) WHERE r <= 3""")
def markers_capped(spark, sf):
    """At most so many markers of a session."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"))
    return mark(o, "custkey", "orderkey", most=3).drop("label")


@query(f"""WITH RECURSIVE e AS (SELECT * FROM ({_CHAIN}) WHERE dst IS NOT NULL), r(start, node, depth) AS (SELECT min(o_orderkey), min(o_orderkey), 0 FROM orders GROUP BY o_custkey
  UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT start, node, repeat(' ', 2 * depth) || 'order ' || node AS line FROM r WHERE depth > 0""")
def call_tree_lines(spark, sf):
    """Callees to a depth as indented lines below their callers, each node once below its start."""
    o = table(spark, sf, "orders")
    edges = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("dst")).filter("dst is not null")
    rows = call_tree(o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("node")), edges.withColumn("at", F.col("dst")), 3).filter("not again")
    text = F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), F.lit("order "), "dst")
    return rows.orderBy("start", "line").select("start", F.col("dst").alias("node"), text.alias("line"))


@query("""WITH g AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS depth FROM conversations)
  SELECT conv_id, turn, depth FROM g WHERE role <> 'user'""")
def nesting_depth(spark, sf):
    """How many opening statements stand before a statement in its block."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.count_if(F.col("role") == "user").over(w).alias("depth"))
    return rows.filter("role <> 'user'").drop("role")


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM t GROUP BY 1""")
def html_elements(spark, sf):
    """Elements of pages by name."""
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    rows = table(spark, sf, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return rows.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


@query("SELECT doc_id, contains(upper(text), 'MIT') AS short FROM documents WHERE contains(upper(text), 'LICENSE') AND NOT contains(upper(text), 'GPL')")
def find_text_and_not(spark, sf):
    d = table(spark, sf, "documents").filter(holds(F.col("text"), "license") & ~holds(F.col("text"), "gpl"))
    return d.select("doc_id", holds(F.col("text"), "mit").alias("short"))
