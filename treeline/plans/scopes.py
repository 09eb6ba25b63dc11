"""Visible names, renames by scope, and texts spliced at many places, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import whole
from ..operators.order_keys import insert_after, labelled, places
from ..operators.scopes import meant, visible
from ..operators.splice import spans_of, splice
from ..sources.folders import dealt, shuffled, stored
from ..sources.trees import page_tree, table
from .catalogue import query
from .pages import _PAGES

#: Scopes are blocks of pages; headings, paragraphs, links and the like declare the name of their kind.
SCOPES, DECLARE, ASK = ("html", "head", "body", "nav", "ul", "div", "article"), ("meta", "title", "h1", "p", "b", "a"), ("h1", "br", "a", "footer")
_LIST = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("scopes", SCOPES), ("declare", DECLARE), ("ask", ASK))}
_MET = _PAGES + """, blocks AS (SELECT t, node_id, sub_end FROM n WHERE kind IN ({scopes})),
  decls AS (SELECT x.t, x.node_id AS decl, x.kind AS name, max(s.node_id) AS scope FROM n x JOIN blocks s ON s.t = x.t AND s.node_id < x.node_id AND s.sub_end >= x.node_id WHERE x.kind IN ({declare}) GROUP BY ALL),
  met AS (SELECT p.t, p.node_id, p.kind, d.name, d.decl, d.scope, row_number() OVER (PARTITION BY p.t, p.node_id, d.name ORDER BY d.scope DESC, d.decl DESC) AS r
    FROM n p JOIN blocks s ON s.t = p.t AND s.node_id < p.node_id AND s.sub_end >= p.node_id JOIN decls d ON d.t = p.t AND d.scope = s.node_id AND d.decl < p.node_id) """.format(**_LIST)


@query(_MET + f"""SELECT page_id, node_id, name, decl FROM (SELECT t AS page_id, node_id, name, decl, row_number() OVER (PARTITION BY t, node_id ORDER BY scope DESC, decl DESC) AS k FROM met WHERE r = 1 AND kind IN ({_LIST['ask']})) WHERE k <= 20""")
def page_visible_names(spark, sf):
    """The names that may be used at a point, inner declarations hiding outer ones; twenty at most."""
    n = page_tree(spark, sf)
    of = n.filter(F.col("kind").isin(*DECLARE)).withColumn("name", F.col("kind"))
    rows = visible(n.filter(F.col("kind").isin(*ASK)), of, n.filter(F.col("kind").isin(*SCOPES)), 20)
    return rows.select(F.col("tree_id").alias("page_id"), "node_id", "name", "decl")


@query(_MET + """, firsts AS (SELECT t, min(node_id) AS decl FROM n WHERE kind = 'a' GROUP BY 1)
  SELECT m.t AS page_id, m.node_id, m.decl, m.decl = f.decl AS renamed FROM met m JOIN firsts f ON f.t = m.t WHERE m.r = 1 AND m.kind = 'a' AND m.name = 'a'""")
def page_rename_by_scope(spark, sf):
    """Links as uses of the link declared before: renaming the first one of a page leaves those that mean another."""
    n = page_tree(spark, sf)
    links = n.filter("kind = 'a'").withColumn("name", F.col("kind"))
    rows = meant(links, links, n.filter(F.col("kind").isin(*SCOPES))).filter("decl is not null")
    first = dealt(links.select("tree_id", "node_id"), links.count(), "tree_id").groupBy("tree_id").agg(F.min("node_id").alias("first"))
    return rows.join(shuffled(first), "tree_id").select(F.col("tree_id").alias("page_id"), "node_id", "decl", (F.col("decl") == F.col("first")).alias("renamed"))


@query(r"""WITH d AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '([^A-Za-z0-9_])', '\1\1', 'g') AS wide FROM documents WHERE text IS NOT NULL),
  a AS (SELECT doc_id, text, ' ' || wide || ' ' AS wide FROM d), b AS (SELECT doc_id, text, wide, len(regexp_extract_all(wide, '[^A-Za-z0-9_]of  the[^A-Za-z0-9_]')) AS longer, len(regexp_extract_all(wide, '[^A-Za-z0-9_]of[^A-Za-z0-9_]')) AS shorter FROM a)
  SELECT doc_id, shorter::BIGINT AS n_edits, longer::BIGINT AS n_refused, length(text) + 1 * (shorter - longer) - 3 * longer AS n_chars,
    md5(regexp_replace(substr(z, 2, length(z) - 2), '([^A-Za-z0-9_])(?:[^A-Za-z0-9_])', '\1', 'g')) AS text
  FROM (SELECT *, regexp_replace(regexp_replace(wide, '([^A-Za-z0-9_])of  the([^A-Za-z0-9_])', '\1des\2', 'g'), '([^A-Za-z0-9_])of([^A-Za-z0-9_])', '\1von\2', 'g') AS z FROM b)""")
def text_splices(spark, sf):
    """Two renames whose spans overlap, as edits of one pass: the longer one stands, the one inside it is refused."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    edits = spans_of(d, "doc_id", "text", whole("of the"), F.lit("des"), 1).unionByName(spans_of(d, "doc_id", "text", whole("of"), F.lit("von"), 2))
    rows = splice(d, edits, "doc_id")
    return rows.select("doc_id", "n_edits", "n_refused", F.length("spliced").cast("long").alias("n_chars"), F.md5("spliced").alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
  SELECT m.conv_id, m.turn, (m.turn + (SELECT count(*) FROM c u WHERE u.conv_id = m.conv_id AND u.turn < m.turn AND u.role = 'assistant') + (SELECT count(*) FROM c u WHERE u.conv_id = m.conv_id AND u.turn < m.turn AND u.turn > 0 AND u.role = 'user') * 2)::BIGINT AS place,
    md5(m.text) AS text FROM c m WHERE m.turn > 0 AND m.role = 'assistant'""")
def markers_over_versions(spark, sf):
    """Where marked turns stand after three versions: a note after each answer, the first turn gone, two notes after each question that is left."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = labelled(turns.select("conv_id", "role", F.concat(F.lit("t"), F.col("turn")).alias("id"), "turn"), "conv_id", "turn").drop("turn")
    # each version is stored: it is read several times by the next, and worked once
    rows = stored(rows, "version")
    marks = turns.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("t"), F.col("turn")).alias("id"), "turn", "text")

    def notes(role: str, name: str):
        return rows.filter(F.col("role") == role).select("conv_id", F.lit("note").alias("role"), F.concat(F.lit(name), "id").alias("id"), F.col("id").alias("after"))

    first = stored(insert_after(rows, notes("assistant", "a-"), "conv_id", "id"), "version")
    second = first.filter("id <> 't0'")
    third = stored(insert_after(second, notes("user", "b-").unionByName(notes("user", "c-")), "conv_id", "id"), "version")
    found = places(third, "conv_id").join(marks, ["conv_id", "id"])
    return found.select("conv_id", "turn", "place", F.md5("text").alias("text"))
