"""Trees of any depth from markup: tags become brackets, and brackets are matched by running sums.

Rules: comments, and what scripts and style sheets hold, are no markup. Void elements and tags that
close themselves are leaves. A close belongs to the nearest open tag of its name that has none yet; an
open tag without one is a leaf (its end was left out), a close without one is dropped. All others nest
by depth: a close ends the innermost element, so that crossing elements still make a tree.

Null markup counts as empty; a page without tags has no nodes; page ids name the trees, and are taken to be
unique. A window holds what a page has of tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.forest import ancestors
from .folders import dealt

#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
RAW = ("script", "style")
TAG = r"""</?[A-Za-z][A-Za-z0-9-]*(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
NAME = r"^</?([A-Za-z][A-Za-z0-9-]*)"
#: So many characters of markup have their tags in one task, whatever the number of pages.
CHARS = 1 << 23
PAGE_NODE = ["tree_id", "kind", "tag", "node_id", "depth", "sub_end", "parent_id"]


def bare(html: Column) -> Column:
    """Markup without comments and without the contents of raw elements."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    for name in RAW:
        out = F.regexp_replace(out, rf"(?is)(<{name}\b[^>]*>).*?(</{name}\s*>)", "$1$2")
    return out


def tasks_for(pages: DataFrame, html_col: str = "html") -> int:
    """How many tasks the tags of the pages are dealt to: as many more as there is more markup."""
    chars = pages.agg(F.sum(F.length(html_col)).alias("n")).first()["n"]
    return 1 + (chars or 0) // CHARS


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """tree_id, pos, tag, kind (the element's name), step (1 open, -1 close, 0 leaf), dealt by page to as many tasks as `tasks_for` says.

    Tags take a hundredth of their size in a shuffle, by which Spark would put tasks together. All windows that
    follow are by page, so that rows are dealt once.
    """
    tags = pages.select(F.col(id_col).cast("long").alias("tree_id"), F.posexplode(F.regexp_extract_all(bare(F.col(html_col)), F.lit(TAG), 0)).alias("pos", "tag"))
    rows = tags.select("tree_id", "pos", "tag", F.lower(F.regexp_extract("tag", NAME, 1)).alias("kind"), F.startswith("tag", F.lit("</")).alias("closing"))
    void = F.col("kind").isin(*VOID)
    step = F.when(F.col("closing"), -1).when(void | F.endswith("tag", F.lit("/>")), 0).otherwise(1)
    return rows.filter(~(F.col("closing") & void)).select("tree_id", "pos", "tag", "kind", step.alias("step")).repartition(tasks or tasks_for(pages, html_col), "tree_id")


def matched(rows: DataFrame) -> DataFrame:
    """The tokens with open tags that nothing closes as leaves, and without closes of nothing."""
    w = Window.partitionBy("tree_id", "kind").orderBy("pos")
    rows = rows.withColumn("sum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # how many elements of the name are open inside a tag; no close of nothing counts
    rows = rows.withColumn("level", F.col("sum") + (F.col("step") == -1).cast("int") - low)
    partner = F.lead("step").over(Window.partitionBy("tree_id", "kind", F.col("step") == 0, "level").orderBy("pos"))
    rows = rows.withColumn("step", F.when((F.col("step") == 1) & F.coalesce(partner != -1, F.lit(True)), 0).otherwise(F.col("step")))
    return rows.filter("step <> -1 or level > 0").drop("sum", "level")


def brackets(rows: DataFrame) -> DataFrame:
    """Matched tokens with depth and node_id; a close has those of the last element before it."""
    w = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("step") == 1
    return rows.withColumns({"depth": (F.sum("step").over(w) - opens.cast("int")).cast("int"), "node_id": (F.count_if(F.col("step") >= 0).over(w) - 1).cast("long")})


def at_close(column: str) -> Column:
    """Of an open bracket its close's column: those of a depth stand in turn."""
    return F.lead(column).over(Window.partitionBy("tree_id", "depth", F.col("step") == 0).orderBy("pos"))


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """PAGE_NODE: a row for each element, numbered in the order of its page."""
    opens = F.col("step") == 1
    rows = brackets(matched(tokens(pages, id_col, html_col)))
    rows = rows.withColumn("sub_end", F.when(opens, at_close("node_id")).otherwise(F.col("node_id"))).filter("step >= 0")
    # an element stands a level down, too, for those that follow there to find it
    levels = F.when(opens, F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("long").alias("above")), F.struct((F.col("depth") + 1).alias("level"), F.col("node_id").alias("above"))))
    rows = rows.withColumn("x", F.explode(F.coalesce(levels, F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("long").alias("above"))))))
    up = F.last("x.above", ignorenulls=True).over(Window.partitionBy("tree_id", "x.level").orderBy("pos", F.col("x.above").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("parent_id", up).filter("x.above is null").select(*PAGE_NODE)


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """nodes with anc, as path steps want it."""
    up = ancestors(nodes)
    return dealt(nodes, up.count(), "tree_id", "node_id").join(up, ["tree_id", "node_id"])


def tag_attribute(tag: Column, name: str) -> Column:
    """An attribute's value in double quotes; null without one."""
    value = F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1)
    return F.when(value != "", value)
