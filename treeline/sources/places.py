"""Where elements of markup stand in its text: offsets, lines, contents, attributes, and what is wrong with it.

Offsets count characters from 0, lines from 1, in the markup as `bare` leaves it (without comments
and without what scripts and style sheets hold). Null markup counts as empty: it has one empty line
and nothing in it. A window holds what a page has of tags; texts stay in their page's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import shuffled
from .markup import TAG, at_close, bare, brackets, matched, tasks_for, tokens

#: Name and value of an attribute; a value stands in quotes of either kind, or bare.
ATTRIBUTE = r"""([A-Za-z_:][A-Za-z0-9_:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def segments(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """tree_id, pos, begin, stop, line, last_line, text_at of every tag: its offsets and lines, and how many characters outside tags stand before it."""
    html = bare(F.col(html_col))
    zipped = F.arrays_zip(F.split(html, TAG, -1).alias("part"), F.regexp_extract_all(html, F.lit(TAG), 0).alias("tag"))
    rows = pages.select(F.col(id_col).cast("long").alias("tree_id"), F.posexplode(zipped).alias("pos", "x")).filter("x.tag is not null")
    # sizes only from here on: no text goes through the window
    rows = rows.select("tree_id", "pos", F.length("x.part").alias("n_text"), F.length("x.tag").alias("n_tag"), newlines(F.col("x.part")).alias("l_text"), newlines(F.col("x.tag")).alias("l_tag")).repartition(tasks or tasks_for(pages, html_col), "tree_id")
    upto = Window.partitionBy("tree_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total = {"text_at": F.sum("n_text").over(upto), "stop": F.sum(F.col("n_text") + F.col("n_tag")).over(upto), "last_line": 1 + F.sum(F.col("l_text") + F.col("l_tag")).over(upto)}
    rows = rows.withColumns(total)
    return rows.select("tree_id", "pos", (F.col("stop") - F.col("n_tag")).alias("begin"), "stop", (F.col("last_line") - F.col("l_tag")).alias("line"), "last_line", "text_at")


def places(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", tasks: int | None = None) -> DataFrame:
    """tree_id, node_id, begin, stop, line, last_line, text_at, text_stop of every element: from its tag to the end of its close, with the same numbers as page_nodes."""
    tasks = tasks or tasks_for(pages, html_col)
    rows = brackets(matched(tokens(pages, id_col, html_col, tasks))).join(shuffled(segments(pages, id_col, html_col, tasks)), ["tree_id", "pos"])
    opens = F.col("step") == 1
    ends = {c: F.when(opens, at_close(c)).otherwise(F.col(c)) for c in ("stop", "last_line")} | {"text_stop": F.when(opens, at_close("text_at")).otherwise(F.col("text_at"))}
    return rows.withColumns(ends).filter("step >= 0").select("tree_id", "node_id", "begin", "stop", "line", "last_line", "text_at", "text_stop")


def contents(nodes: DataFrame, pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """nodes (with text_at and text_stop) with `content`: all text inside an element, cut out of its page's text, tags left out."""
    texts = pages.select(F.col(id_col).cast("long").alias("tree_id"), F.regexp_replace(bare(F.col(html_col)), TAG, "").alias("_text"))
    cut = F.substring("_text", F.col("text_at").cast("int") + 1, (F.col("text_stop") - F.col("text_at")).cast("int"))
    return nodes.join(shuffled(texts), "tree_id").withColumn("content", cut).drop("_text")


def around(found: DataFrame, pages: DataFrame, k: int = 2, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """found (with line and last_line) once for each line from k before the element to k after it: line_no, text, hit (whether the element stands in it).

    Lines are cut out of the page's row by a bounded slice, so that no page is spread over its lines.
    """
    lines = pages.select(F.col(id_col).cast("long").alias("tree_id"), F.split(bare(F.col(html_col)), "\n", -1).alias("_lines"))
    first = F.greatest(F.lit(1), F.col("line") - k).cast("int")
    last = F.least(F.size("_lines"), F.col("last_line") + k).cast("int")
    rows = found.join(shuffled(lines), "tree_id").withColumn("_first", first)
    rows = rows.withColumn("_near", F.slice("_lines", F.col("_first"), last - F.col("_first") + 1)).drop("_lines")
    rows = rows.select(*found.columns, "_first", F.posexplode("_near").alias("_k", "text")).withColumn("line_no", (F.col("_first") + F.col("_k")).cast("long"))
    return rows.withColumn("hit", F.col("line_no").between(F.col("line"), F.col("last_line"))).drop("_first", "_k")


def attributes_of(tag: Column) -> Column:
    """A tag's attributes as an array of (name, value): names in lower case, the first of a name, a value without its quotes, '' where there is none."""
    inside = F.regexp_extract(tag, r"(?s)^</?[A-Za-z][A-Za-z0-9-]*(.*?)/?>$", 1)
    names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 2)

    def pair(name: Column) -> Column:
        return F.struct(name.alias("name"), F.regexp_replace(F.element_at(values, F.array_position(names, name).cast("int")), "^[\"']|[\"']$", "").alias("value"))

    return F.transform(F.array_distinct(names), pair)


def diagnostics(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """tree_id, pos, code, kind, begin, line: elements that nothing closes ('unclosed') and closes of nothing ('stray')."""
    tasks = tasks_for(pages, html_col)
    given = tokens(pages, id_col, html_col, tasks)
    kept = matched(given).select("tree_id", "pos", F.col("step").alias("now"))
    rows = given.filter("step <> 0").join(shuffled(kept), ["tree_id", "pos"], "left")
    code = F.when(F.col("now").isNull(), "stray").when(F.col("now") != F.col("step"), "unclosed")
    rows = rows.select("tree_id", "pos", "kind", code.alias("code")).filter("code is not null")
    return rows.join(shuffled(segments(pages, id_col, html_col, tasks)).select("tree_id", "pos", "begin", "line"), ["tree_id", "pos"])
