"""Trees of pages, of any depth: numbers, axes, paths, dumps and flow over nested blocks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dumps import nested
from ..operators.flow import always_assigned, conditional_assignments, unreachable
from ..operators.forest import forest_numbers
from ..operators.paths import At, Has, Step, limited, node_paths, path
from ..operators.spans import nearest
from ..operators.steps import exists, step
from ..sources.markup import RAW, VOID, tag_attribute
from ..sources.trees import page_tree
from .catalogue import kind, query

_VOID = ", ".join(f"'{v}'" for v in VOID)
_BARE = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
for _name in RAW:
    _BARE = rf"regexp_replace({_BARE}, '(?is)(<{_name}\b[^>]*>).*?(</{_name}\s*>)', '\1\2', 'g')"
#: The node table of pages in SQL: n (t, kind, tag, node_id, depth, sub_end, parent_id).
_PAGES = rf"""WITH a AS (SELECT page_id AS t, regexp_extract_all({_BARE}, '</?[A-Za-z][A-Za-z0-9-]*(?:[^>"'']+|"[^"]*"|''[^'']*'')*>') AS tags FROM pages),
  b AS (SELECT t, generate_subscripts(tags, 1) AS pos, unnest(tags) AS tag FROM a),
  c AS (SELECT *, lower(regexp_extract(tag, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS kind FROM b),
  d AS (SELECT *, CASE WHEN starts_with(tag, '</') THEN -1 WHEN kind IN ({_VOID}) OR ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM c WHERE NOT (starts_with(tag, '</') AND kind IN ({_VOID}))),
  e AS (SELECT *, sum(step) OVER (PARTITION BY t, kind ORDER BY pos) AS s FROM d),
  f AS (SELECT *, s + CASE WHEN step = -1 THEN 1 ELSE 0 END - least(0, coalesce(min(s) OVER (PARTITION BY t, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM e),
  g AS (SELECT *, lead(step) OVER (PARTITION BY t, kind, step = 0, level ORDER BY pos) AS partner FROM f),
  h AS (SELECT t, pos, tag, kind, CASE WHEN step = 1 AND coalesce(partner, 0) <> -1 THEN 0 ELSE step END AS step FROM g WHERE step <> -1 OR level > 0),
  i AS (SELECT *, (sum(step) OVER w - CASE WHEN step = 1 THEN 1 ELSE 0 END)::INT AS depth, count(*) FILTER (step >= 0) OVER w - 1 AS node_id FROM h WINDOW w AS (PARTITION BY t ORDER BY pos)),
  j AS (SELECT *, CASE WHEN step = 1 THEN lead(node_id) OVER (PARTITION BY t, depth, step = 0 ORDER BY pos) ELSE node_id END AS sub_end FROM i),
  m AS (SELECT t, kind, tag, node_id, depth, sub_end FROM j WHERE step >= 0),
  n AS (SELECT m.*, p.parent_id FROM m LEFT JOIN (SELECT x.t, x.node_id, max(y.node_id) AS parent_id FROM m x JOIN m y ON y.t = x.t AND y.depth = x.depth - 1 AND y.node_id < x.node_id AND y.sub_end >= x.node_id GROUP BY 1, 2) p USING (t, node_id)) """
_COLUMNS = "t AS page_id, kind, node_id, depth, sub_end, parent_id"


@query(_PAGES + f"SELECT {_COLUMNS}, md5(tag) AS tag FROM n")
def page_elements(spark, sf):
    """Every element of every page with its place in the tree."""
    return page_tree(spark, sf).select(F.col("tree_id").alias("page_id"), "kind", "node_id", "depth", "sub_end", "parent_id", F.md5("tag").alias("tag"))


@query(_PAGES + f"SELECT {_COLUMNS} FROM n")
def page_numbers_by_links(spark, sf):
    """The same numbers from parent links alone, by ranking the tour of each tree."""
    n = page_tree(spark, sf)
    links = n.select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("node_id").alias("place"))
    return forest_numbers(links, "place").join(n.select("tree_id", F.col("node_id").alias("node"), "kind"), ["tree_id", "node"]).select(F.col("tree_id").alias("page_id"), "kind", "node_id", "depth", "sub_end", "parent_id")


@query(_PAGES + "SELECT x.t AS page_id, x.node_id AS node, y.kind, count(*) AS n FROM n x JOIN n y ON y.t = x.t AND y.node_id > x.node_id AND y.node_id <= x.sub_end WHERE x.kind IN ('nav', 'article', 'body') GROUP BY ALL")
def page_descendants(spark, sf):
    n = page_tree(spark, sf)
    return step(n.filter(F.col("kind").isin("nav", "article", "body")), n, "descendant", None, ("node_id",)).groupBy(F.col("tree_id").alias("page_id"), F.col("ctx_node_id").alias("node"), "kind").agg(F.count("*").alias("n"))


@query(_PAGES + "SELECT x.t AS page_id, x.node_id AS node, y.kind AS above, y.depth FROM n x JOIN n y ON y.t = x.t AND y.node_id < x.node_id AND y.sub_end >= x.node_id WHERE x.kind = 'a'")
def page_ancestors(spark, sf):
    n = page_tree(spark, sf)
    return step(kind(n, "a"), n, "ancestor", None, ("node_id",)).select(F.col("tree_id").alias("page_id"), F.col("ctx_node_id").alias("node"), F.col("kind").alias("above"), "depth")


@query(_PAGES + """SELECT x.t AS page_id, x.node_id AS node, y.kind, count(*) AS n FROM n x JOIN n p ON p.t = x.t AND p.node_id = x.parent_id JOIN n y ON y.t = x.t AND y.node_id > x.node_id AND y.node_id <= p.sub_end WHERE x.kind = 'h1' GROUP BY ALL""")
def page_following(spark, sf):
    """What follows a heading within its parent's subtree."""
    n = page_tree(spark, sf)
    return step(kind(n, "h1"), n, "following", None, ("node_id",)).groupBy(F.col("tree_id").alias("page_id"), F.col("ctx_node_id").alias("node"), "kind").agg(F.count("*").alias("n"))


@query(_PAGES + "SELECT x.t AS page_id, x.node_id AS node, count(*) AS n, max(y.node_id) AS nearest FROM n x JOIN n y ON y.t = x.t AND y.parent_id = x.parent_id AND y.node_id < x.node_id WHERE x.kind = 'footer' OR x.kind = 'article' GROUP BY ALL")
def page_preceding_siblings(spark, sf):
    n = page_tree(spark, sf)
    near = step(n.filter(F.col("kind").isin("footer", "article")), n, "preceding-sibling", None, ("node_id",))
    return near.groupBy(F.col("tree_id").alias("page_id"), F.col("ctx_node_id").alias("node")).agg(F.count("*").alias("n"), F.max("node_id").alias("nearest"))


@query(_PAGES + "SELECT t AS page_id, kind, node_id FROM n x WHERE x.sub_end > x.node_id AND NOT EXISTS (SELECT 1 FROM n y WHERE y.t = x.t AND y.node_id > x.node_id AND y.node_id <= x.sub_end AND y.kind IN ('p', 'a'))")
def page_without_text(spark, sf):
    """Elements with something in them, but no paragraph or link at any depth."""
    n = page_tree(spark, sf)
    inner = exists(n, n.filter(F.col("kind").isin("p", "a")), "descendant", negate=True, rows=n.count())
    return inner.filter("sub_end > node_id").select(F.col("tree_id").alias("page_id"), "kind", "node_id")


@query(_PAGES + r"""SELECT page_id, nav, node_id, href FROM (SELECT v.t AS page_id, v.node_id AS nav, l.node_id AS li, a.node_id, regexp_extract(a.tag, '(?i)\shref\s*=\s*"([^"]*)"', 1) AS href, dense_rank() OVER (PARTITION BY u.t, u.node_id ORDER BY l.node_id DESC) AS r
  FROM n v JOIN n u ON u.t = v.t AND u.parent_id = v.node_id AND u.kind = 'ul' JOIN n l ON l.t = v.t AND l.parent_id = u.node_id AND l.kind = 'li' JOIN n a ON a.t = v.t AND a.parent_id = l.node_id AND a.kind = 'a' WHERE v.kind = 'nav') WHERE r = 2""")
def page_path(spark, sf):
    """nav/ul/li[last()-1]/a with its href, of lists whose entries all hold a link"""
    n = page_tree(spark, sf)
    steps = (Step("child", "ul"), Step("child", "li", (Has((Step("child", "a"),)), At(2, last=True))), Step("child", "a"))
    rows = path(kind(n, "nav").withColumn("nav", F.col("node_id")), n, steps, carry=("nav",))
    return rows.select(F.col("tree_id").alias("page_id"), "nav", "node_id", F.coalesce(tag_attribute(F.col("tag"), "href"), F.lit("")).alias("href"))


@query(_PAGES + """, o AS (SELECT *, row_number() OVER (PARTITION BY t, parent_id, kind ORDER BY node_id) AS ordinal FROM n)
  SELECT x.t AS page_id, x.node_id, '/' || string_agg(y.kind || '[' || y.ordinal || ']', '/' ORDER BY y.node_id) AS path FROM n x JOIN o y ON y.t = x.t AND y.node_id <= x.node_id AND y.sub_end >= x.node_id GROUP BY ALL""")
def page_node_paths(spark, sf):
    n = page_tree(spark, sf)
    rows = node_paths(n, n, F.concat("kind", F.lit("["), F.col("ordinal").cast("string"), F.lit("]")))
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", "path")


@query(_PAGES + """SELECT x.t AS page_id, x.node_id, x.depth, count(y.node_id) AS children, x.depth = 3 AND count(y.node_id) > 0 AS truncated FROM n x LEFT JOIN n y ON y.t = x.t AND y.parent_id = x.node_id WHERE x.depth <= 3 GROUP BY 1, 2, 3""")
def page_depth_limited(spark, sf):
    rows = limited(page_tree(spark, sf), 3)
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", "depth", "children", "truncated")


@query(_PAGES + "SELECT x.t AS page_id, x.node_id AS node, max(y.node_id) AS found FROM n x LEFT JOIN n y ON y.t = x.t AND y.node_id < x.node_id AND y.sub_end >= x.node_id AND y.kind IN ('nav') WHERE x.kind = 'a' GROUP BY ALL")
def page_nearest(spark, sf):
    """The nav around each link."""
    n = page_tree(spark, sf)
    return nearest(kind(n, "a"), n, "nav").select(F.col("tree_id").alias("page_id"), F.col("node_id").alias("node"), "found")


def _dump_sql(depth: int, most: int) -> str:
    """Values of the deepest level first, each put into its parent's."""
    ctes, below = [], ""
    for d in range(depth, -1, -1):
        kids = "'[]'" if d == depth else "coalesce(k.list, '[]')"
        more = f"(SELECT count(*) FROM n z WHERE z.t = x.t AND z.parent_id = x.node_id) > {most if d < depth else 0}"
        join = "" if d == depth else f"LEFT JOIN (SELECT t, parent_id, '[' || string_agg(v, ',' ORDER BY node_id) || ']' AS list FROM (SELECT *, row_number() OVER (PARTITION BY t, parent_id ORDER BY node_id) AS r FROM {below}) WHERE r <= {most} GROUP BY 1, 2) k ON k.t = x.t AND k.parent_id = x.node_id"
        value = f"""'{{"kind":"' || x.kind || '","node":' || x.node_id || ',"truncated":' || ({more})::VARCHAR || ',"children":' || {kids} || '}}'"""
        ctes.append(f"v{d} AS (SELECT x.t, x.node_id, x.parent_id, {value} AS v FROM n x {join} WHERE x.depth = {d})")
        below = f"v{d}"
    return _PAGES + ", " + ", ".join(ctes) + " SELECT t AS page_id, node_id, v AS dump FROM v0"


@query(_dump_sql(4, 5))
def page_dumps(spark, sf):
    """Each root as nested text to a depth of four, five children to an element at most."""
    return nested(page_tree(spark, sf), depth=4, most=5).select(F.col("tree_id").alias("page_id"), "node_id", "dump")


#: Elements as blocks of statements: entries of a list are the arms of a branch, navigation and boxes run or not.
ROLES = {"ul": "branch", "nav": "loop", "div": "loop"}
_ROLES = "CASE kind WHEN 'ul' THEN 'branch' WHEN 'nav' THEN 'loop' WHEN 'div' THEN 'loop' ELSE 'seq' END"
#: s: assignments, each with its nearest branch or loop; u: what a block assigns up to there, a branch with what all its arms assign.
_FLOW = (
    _PAGES
    + f""", r AS (SELECT *, {_ROLES} AS role FROM n),
  s AS (SELECT x.t, x.node_id, x.kind AS var, max(y.node_id) AS stop FROM r x LEFT JOIN r y ON y.t = x.t AND y.node_id < x.node_id AND y.sub_end >= x.node_id AND y.role <> 'seq' WHERE x.kind IN ({{}}) GROUP BY ALL),
  u0 AS (SELECT DISTINCT s.t, y.node_id, s.var FROM s JOIN r y ON y.t = s.t AND y.node_id <= s.node_id AND y.sub_end >= s.node_id AND y.node_id > coalesce(s.stop, -1)),
  q AS (SELECT t, parent_id, count(*) AS arms FROM r GROUP BY ALL),
  b0 AS (SELECT p.t, p.node_id, u.var FROM r p JOIN r c ON c.t = p.t AND c.parent_id = p.node_id JOIN u0 u ON u.t = c.t AND u.node_id = c.node_id JOIN q ON q.t = p.t AND q.parent_id = p.node_id WHERE p.role = 'branch' GROUP BY p.t, p.node_id, u.var, arms HAVING count(*) = arms),
  b1 AS (SELECT b0.t, b0.node_id, b0.var, max(y.node_id) AS stop FROM b0 LEFT JOIN r y ON y.t = b0.t AND y.node_id < b0.node_id AND y.sub_end >= b0.node_id AND y.role <> 'seq' GROUP BY ALL),
  u AS (SELECT * FROM u0 UNION SELECT b1.t, y.node_id, b1.var FROM b1 JOIN r y ON y.t = b1.t AND y.node_id <= b1.node_id AND y.sub_end >= b1.node_id AND y.node_id > coalesce(b1.stop, -1)) """
)
_VARS = "'a', 'p', 'b', 'h1', 'meta'"


def _blocks(spark, sf):
    n = page_tree(spark, sf)
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ROLES.items() for x in p]), F.col("kind")), F.lit("seq"))
    return n.withColumn("role", role)


def _assignments(blocks):
    return blocks.filter(F.col("kind").isin("a", "p", "b", "h1", "meta")).select("tree_id", "node_id", F.col("kind").alias("var"))


@query(_FLOW.format(_VARS) + "SELECT t AS page_id, node_id, var FROM u")
def page_always_assigned(spark, sf):
    """What each block surely assigns; lists within lists do not occur in the given pages."""
    b = _blocks(spark, sf)
    return always_assigned(b, _assignments(b)).select(F.col("tree_id").alias("page_id"), "node_id", "var")


@query(_FLOW.format(_VARS) + "SELECT DISTINCT s.t AS page_id, y.node_id, s.var FROM s JOIN r y ON y.t = s.t AND y.node_id <= s.node_id AND y.sub_end >= s.node_id WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.t = s.t AND u.node_id = y.node_id AND u.var = s.var)")
def page_conditional_assignments(spark, sf):
    """The warning for what is assigned on some ways through a block only."""
    b = _blocks(spark, sf)
    return conditional_assignments(b, _assignments(b)).select(F.col("tree_id").alias("page_id"), "node_id", "var")


_STOPS = "'br'"


@query(_FLOW.format(_STOPS) + """, first AS (SELECT x.t, x.parent_id, min(x.node_id) AS f FROM r x JOIN u ON u.t = x.t AND u.node_id = x.node_id JOIN r p ON p.t = x.t AND p.node_id = x.parent_id WHERE p.role <> 'branch' GROUP BY 1, 2),
  dead AS (SELECT x.t, x.node_id, x.sub_end FROM r x JOIN first ON first.t = x.t AND first.parent_id = x.parent_id AND x.node_id > f)
  SELECT r.t AS page_id, r.node_id, NOT EXISTS (SELECT 1 FROM u WHERE u.t = r.t AND u.node_id = r.node_id) AS end_reached, EXISTS (SELECT 1 FROM dead d WHERE d.t = r.t AND d.node_id <= r.node_id AND d.sub_end >= r.node_id) AS dead FROM r""")
def page_reachability(spark, sf):
    """For each block whether its end is reached and whether it never runs, a line break being an exit."""
    b = _blocks(spark, sf)
    stuck, dead = unreachable(b, b.filter("kind = 'br'"))
    rows = b.select("tree_id", "node_id").join(stuck.withColumn("stuck", F.lit(True)), ["tree_id", "node_id"], "left").join(dead.withColumn("dead", F.lit(True)), ["tree_id", "node_id"], "left")
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", F.col("stuck").isNull().alias("end_reached"), F.col("dead").isNotNull().alias("dead"))


_NESTS = ("nav", "ul", "li", "div", "article")


@query(_PAGES + f"SELECT x.t AS page_id, x.node_id, count(y.node_id) AS depth FROM n x LEFT JOIN n y ON y.t = x.t AND y.node_id < x.node_id AND y.sub_end >= x.node_id AND y.kind IN {_NESTS} GROUP BY 1, 2")
def page_nesting_depth(spark, sf):
    """How many blocks an element stands in, by its ancestors."""
    n = page_tree(spark, sf)
    blocks = n.filter(F.col("kind").isin(*_NESTS)).select("tree_id", F.col("node_id").alias("up"))
    inside = n.select("tree_id", "node_id", F.explode("anc").alias("up")).join(blocks, ["tree_id", "up"]).groupBy("tree_id", "node_id").agg(F.count("*").alias("blocks"))
    return n.join(inside, ["tree_id", "node_id"], "left").select(F.col("tree_id").alias("page_id"), "node_id", F.coalesce("blocks", F.lit(0)).alias("depth"))
