"""Pages as source text: places of elements, their contents and attributes, lines around what a path finds, diagnostics and the context of a statement, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import after, before, normalize_space
from ..operators.paths import At, Has, Step, path
from ..operators.scopes import visible
from ..operators.spans import spots_within
from ..sources.markup import tasks_for
from ..sources.places import around, attributes_of, contents, diagnostics, places
from ..sources.trees import page_tree, table
from .catalogue import kind, query
from .pages import _BARE, _PAGES
from .scopes import _LIST, _MET, DECLARE, SCOPES

_TAG = """</?[A-Za-z][A-Za-z0-9-]*(?:[^>"'']+|"[^"]*"|''[^'']*'')*>"""
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"
#: sg: offsets and lines of tags; pl: the same of elements; tx: what elements contain.
_PLACES = f""", sg0 AS (SELECT t, generate_subscripts(parts, 1) AS pos, unnest(parts) AS part, unnest(list_append(tags, NULL)) AS tag FROM (SELECT page_id AS t, string_split_regex({_BARE}, '{_TAG}') AS parts, regexp_extract_all({_BARE}, '{_TAG}') AS tags FROM pages)),
  sg AS (SELECT t, pos, (sum(length(part)) OVER w)::BIGINT AS text_at, (sum(length(part) + length(tag)) OVER w)::BIGINT AS stop, (sum(length(part) + length(tag)) OVER w - length(tag))::BIGINT AS start,
    (1 + sum({_NL.format('part')} + {_NL.format('tag')}) OVER w)::BIGINT AS last_line, (1 + sum({_NL.format('part')} + {_NL.format('tag')}) OVER w - {_NL.format('tag')})::BIGINT AS line FROM sg0 WHERE tag IS NOT NULL WINDOW w AS (PARTITION BY t ORDER BY pos)),
  pl0 AS (SELECT i.t, i.node_id, i.kind, i.step, i.tag, sg.start, sg.line, CASE WHEN step = 1 THEN lead(sg.stop) OVER v ELSE sg.stop END AS stop, CASE WHEN step = 1 THEN lead(sg.last_line) OVER v ELSE sg.last_line END AS last_line,
    sg.text_at, CASE WHEN step = 1 THEN lead(sg.text_at) OVER v ELSE sg.text_at END AS text_stop FROM i JOIN sg USING (t, pos) WINDOW v AS (PARTITION BY i.t, i.depth, i.step = 0 ORDER BY i.pos)),
  pl AS (SELECT * FROM pl0 WHERE step >= 0),
  tx AS (SELECT pl.*, substr(regexp_replace({_BARE}, '{_TAG}', '', 'g'), text_at + 1, text_stop - text_at) AS content FROM pl JOIN pages ON page_id = t) """


def _placed(nodes, spark, sf):
    pages = table(spark, sf, "pages")
    tasks = tasks_for(pages)  # both sides by page: places are there already
    return nodes.repartition(tasks, "tree_id").join(places(pages, tasks=tasks), ["tree_id", "node_id"])


@query(_PAGES + _PLACES + "SELECT t AS page_id, node_id, kind, start, stop, line, last_line, text_stop - text_at AS chars FROM pl")
def page_places(spark, sf):
    """Where every element begins and ends, and how much text it holds."""
    rows = _placed(page_tree(spark, sf).select("tree_id", "node_id", "kind"), spark, sf)
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", "kind", F.col("begin").alias("start"), "stop", "line", "last_line", (F.col("text_stop") - F.col("text_at")).alias("chars"))


@query(_PAGES + _PLACES + r"""SELECT t AS page_id, node_id, kind AS local_name, '' AS namespace, length(content) AS string_length, md5(trim(regexp_replace(content, '[ \t\n\r]+', ' ', 'g'))) AS normal,
  CASE WHEN contains(content, '.') THEN md5(split_part(content, '.', 1)) ELSE md5('') END AS first_sentence, CASE WHEN contains(content, '.') THEN md5(substr(content, strpos(content, '.') + 1)) ELSE md5('') END AS other_sentences
  FROM tx WHERE kind IN ('title', 'h1', 'li', 'b', 'footer', 'article') AND content <> ''""")
def page_contents(spark, sf):
    """The string functions over what elements contain, of elements that hold any text."""
    n = page_tree(spark, sf).filter(F.col("kind").isin("title", "h1", "li", "b", "footer", "article")).select("tree_id", "node_id", "kind")
    rows, text = contents(_placed(n, spark, sf), table(spark, sf, "pages")).filter("content <> ''"), F.col("content")
    return rows.select(
        F.col("tree_id").alias("page_id"), "node_id", F.col("kind").alias("local_name"), F.lit("").alias("namespace"), F.length(text).cast("long").alias("string_length"), F.md5(normalize_space(text)).alias("normal"),
        F.md5(before(text, ".")).alias("first_sentence"), F.md5(after(text, ".")).alias("other_sentences"),
    )


@query(_PAGES + _PLACES + f""", hits AS (SELECT p.t, b.node_id FROM n p JOIN n b ON b.t = p.t AND b.parent_id = p.node_id AND b.kind = 'p' WHERE p.kind = 'article' AND EXISTS (SELECT 1 FROM n f WHERE f.t = p.t AND f.parent_id = p.node_id AND f.kind = 'h1')),
  ls AS (SELECT t, generate_subscripts(l, 1) AS line_no, unnest(l) AS text FROM (SELECT page_id AS t, string_split({_BARE}, chr(10)) AS l FROM pages))
  SELECT h.t AS page_id, h.node_id, ls.line_no, md5(ls.text) AS text, ls.line_no BETWEEN pl.line AND pl.last_line AS hit FROM hits h JOIN pl USING (t, node_id) JOIN ls ON ls.t = h.t AND ls.line_no BETWEEN pl.line - 2 AND pl.last_line + 2""")
def page_path_context(spark, sf):
    """article[h1]/p with two lines around what it finds."""
    n, pages = page_tree(spark, sf), table(spark, sf, "pages")
    found = path(n, n, (Step("self", "article", (Has((Step("child", "h1"),)),)), Step("child", "p")), distinct=True)
    rows = around(_placed(found.select("tree_id", "node_id"), spark, sf), pages, 2)
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", "line_no", F.md5("text").alias("text"), "hit")


@query(_PAGES + """, s AS (SELECT u.t, l.node_id, row_number() OVER (PARTITION BY u.t ORDER BY l.node_id) AS k, row_number() OVER (PARTITION BY u.t ORDER BY l.node_id DESC) AS z FROM n u JOIN n l ON l.t = u.t AND l.parent_id = u.node_id AND l.kind IN ('p', 'b', 'br') WHERE u.kind IN ('article', 'p'))
  SELECT t AS page_id, node_id, CASE WHEN k = 3 THEN 'third' ELSE 'last' END AS place FROM s WHERE k = 3 UNION ALL SELECT t, node_id, 'last' FROM s WHERE z = 1""")
def page_whole_position(spark, sf):
    """The third and the last of all that a step has found in a page, whatever it was found from."""
    n = page_tree(spark, sf)
    inner, start = F.col("kind").isin("p", "b", "br"), n.filter(F.col("kind").isin("article", "p"))
    rows = [path(start, n, (Step("child", None, (inner, at)),)).withColumn("place", F.lit(name)) for at, name in ((At(3, whole=True), "third"), (At(1, last=True, whole=True), "last"))]
    return rows[0].unionByName(rows[1]).select(F.col("tree_id").alias("page_id"), "node_id", "place")


_ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*("[^"]*"|''[^'']*''|[^\s"''=<>`]+))?"""
_ATTRIBUTES = rf""", x0 AS (SELECT t, node_id, kind, regexp_extract(tag, '^</?[A-Za-z][A-Za-z0-9-]*(.*?)/?>$', 1, 's') AS body FROM n),
  x1 AS (SELECT t, node_id, kind, generate_subscripts(regexp_extract_all(body, '{_ATTRIBUTE}', 1), 1) AS nth, lower(unnest(regexp_extract_all(body, '{_ATTRIBUTE}', 1))) AS name, unnest(regexp_extract_all(body, '{_ATTRIBUTE}', 2)) AS value FROM x0),
  xa AS (SELECT t, node_id, kind, name, regexp_replace(coalesce(value, ''), '^["'']|["'']$', '', 'g') AS value FROM x1 QUALIFY row_number() OVER (PARTITION BY t, node_id, name ORDER BY nth) = 1) """


@query(_PAGES + _ATTRIBUTES + "SELECT t AS page_id, node_id, kind, name, value FROM xa")
def page_attributes(spark, sf):
    """Every attribute of every element, whatever its name."""
    rows = page_tree(spark, sf).select(F.col("tree_id").alias("page_id"), "node_id", "kind", F.explode(attributes_of(F.col("tag"))).alias("x"))
    return rows.select("page_id", "node_id", "kind", "x.name", "x.value")


@query(_PAGES + _ATTRIBUTES + """SELECT n.t AS page_id, n.node_id, xa.value AS href FROM n JOIN xa ON xa.t = n.t AND xa.node_id = n.node_id AND xa.name = 'href' AND starts_with(xa.value, '/') WHERE n.kind = 'a'
  AND NOT EXISTS (SELECT 1 FROM xa z WHERE z.t = n.t AND z.node_id = n.node_id AND z.name = 'class') AND EXISTS (SELECT 1 FROM n y JOIN n u ON u.t = y.t AND u.node_id < y.node_id AND u.sub_end >= y.node_id AND u.kind = 'nav' WHERE y.t = n.t AND y.node_id = n.node_id)""")
def page_path_attributes(spark, sf):
    """nav//a[starts-with(@href, '/') and not(@class)]: attributes of any name in a path's predicates."""
    n = page_tree(spark, sf)
    of = F.map_from_entries(attributes_of(F.col("tag")))
    href = F.try_element_at(of, F.lit("href"))
    rows = path(kind(n, "nav"), n, (Step("descendant", "a", (F.startswith(href, F.lit("/")), F.try_element_at(of, F.lit("class")).isNull())),), distinct=True)
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", href.alias("href"))


_WRONG = """, dg AS (SELECT d.t, d.pos, d.kind, CASE WHEN h.step IS NULL THEN 'stray' ELSE 'unclosed' END AS code FROM d LEFT JOIN h ON h.t = d.t AND h.pos = d.pos WHERE d.step <> 0 AND (h.step IS NULL OR h.step <> d.step)) """


@query(_PAGES + _PLACES + _WRONG + "SELECT dg.t AS page_id, dg.code, dg.kind, sg.start, sg.line FROM dg JOIN sg USING (t, pos)")
def page_diagnostics(spark, sf):
    """What is wrong with each page, by place."""
    rows = diagnostics(table(spark, sf, "pages"))
    return rows.select(F.col("tree_id").alias("page_id"), "code", "kind", F.col("begin").alias("start"), "line").orderBy("page_id", "start")


_TYPE = "CASE WHEN trim({0}) = '' THEN 'empty' WHEN regexp_matches(trim({0}), '^[+-]?[0-9]+([.][0-9]+)?$') THEN 'number' ELSE 'text' END"


@query(_MET + _PLACES + _WRONG + f""", names AS (SELECT t, node_id, string_agg(name || '@' || decl, ',' ORDER BY name) AS visible FROM (SELECT *, row_number() OVER (PARTITION BY t, node_id ORDER BY scope DESC, decl DESC) AS k FROM met WHERE r = 1 AND kind IN ({_LIST['ask']})) WHERE k <= 20 GROUP BY 1, 2),
  blk AS (SELECT x.t, x.node_id, max(y.node_id) AS block FROM n x JOIN n y ON y.t = x.t AND y.node_id < x.node_id AND y.sub_end >= x.node_id AND y.kind IN ({_LIST['scopes']}) WHERE x.kind IN ({_LIST['ask']}) GROUP BY 1, 2),
  bad AS (SELECT blk.t, blk.node_id, count(*) AS wrong FROM blk JOIN pl ON pl.t = blk.t AND pl.node_id = blk.block JOIN dg ON dg.t = blk.t JOIN sg ON sg.t = dg.t AND sg.pos = dg.pos AND sg.start >= pl.start AND sg.start < pl.stop GROUP BY 1, 2)
  SELECT n.t AS page_id, n.node_id, n.kind, {_TYPE.format('tx.content')} AS type, tx.line, blk.block, coalesce(names.visible, '') AS visible, coalesce(bad.wrong, 0) AS diagnostics, n.sub_end - n.node_id > 5 AS can_extract
  FROM n JOIN tx ON tx.t = n.t AND tx.node_id = n.node_id LEFT JOIN names ON names.t = n.t AND names.node_id = n.node_id LEFT JOIN blk ON blk.t = n.t AND blk.node_id = n.node_id LEFT JOIN bad ON bad.t = n.t AND bad.node_id = n.node_id WHERE n.kind IN ({_LIST['ask']})""")
def page_statement_context(spark, sf):
    """What there is to know at a statement: what kind of value it holds, its block, the names that may be used, and how much is wrong in its block."""
    n, pages, key = page_tree(spark, sf), table(spark, sf, "pages"), ["tree_id", "node_id"]
    asked = n.filter(F.col("kind").isin("h1", "br", "a", "footer"))
    blocks = n.filter(F.col("kind").isin(*SCOPES))
    of = n.filter(F.col("kind").isin(*DECLARE)).withColumn("name", F.col("kind"))
    names = visible(asked, of, blocks, 20).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.concat("name", F.lit("@"), "decl"))), ",").alias("visible"))  # twenty at most
    around_ = asked.select(*key, F.explode("anc").alias("up")).join(blocks.select("tree_id", F.col("node_id").alias("up")), ["tree_id", "up"]).groupBy(*key).agg(F.max("up").alias("block"))
    spots = diagnostics(pages).select("tree_id", F.col("begin").alias("at"))
    spans = _placed(blocks.select(*key), spark, sf).select("tree_id", F.col("node_id").alias("span"), "begin", "stop")
    bad = spots_within(spans, spots).select("tree_id", F.col("span").alias("block"), F.col("n_spots").alias("wrong"))
    rows = contents(_placed(asked, spark, sf), pages).join(names, key, "left").join(around_, key, "left").join(bad, ["tree_id", "block"], "left")
    text = F.trim("content")
    type_ = F.when(text == "", "empty").when(text.rlike(r"^[+-]?[0-9]+([.][0-9]+)?$"), "number").otherwise("text")
    return rows.select(
        F.col("tree_id").alias("page_id"), "node_id", "kind", type_.alias("type"), "line", "block", F.coalesce("visible", F.lit("")).alias("visible"), F.coalesce("wrong", F.lit(0)).alias("diagnostics"), (F.col("sub_end") - F.col("node_id") > 5).alias("can_extract"),
    )
