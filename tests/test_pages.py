import json
import re

import pytest
from pyspark.sql import functions as F
from treeline.operators.dumps import nested
from treeline.operators.forest import ancestors, forest_numbers
from treeline.operators.paths import Step, path
from treeline.sources import markup, store
from treeline.sources.trees import numbered, page_tree, sales, sales_rows

PAGES = [
    (1, "<html><body><p>one<p>two</p><br/><ul><li>a<li>b</ul></body></html>"),
    (2, "</p><b><i></b></i><IMG src='a>b'><a href=\"x>y\">z</a>"),
    (3, None),
    (4, "no tags"),
    (5, "<div><!-- <p> --><script>var t = \"</div>\"; '<p>'</script><div></div></div></div>"),
    (6, "<i>" * 3 + "</i>" * 5 + "<a></a>"),
    (7, "<div>" * 300 + "<p></p>" + "</div>" * 300),
    (8, "<a title=\"open><b></b>"),
]


def stack(html):
    """The rules by a walk with a stack: (kind, node, depth, end, parent)."""
    text = re.sub(r"(?s)<!--.*?-->", "", html or "")
    for name in markup.RAW:
        text = re.sub(rf"(?is)(<{name}\b[^>]*>).*?(</{name}\s*>)", r"\1\2", text)
    tags, still = [], {}
    for m in re.finditer(r"""<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", text):
        name, close = m[2].lower(), bool(m[1])
        void = name in markup.VOID
        if close and void:
            continue
        tags.append([name, -1 if close else 0 if void or m[0].endswith("/>") else 1])
        if tags[-1][1] == 1:
            still.setdefault(name, []).append(len(tags) - 1)
        elif close and still.get(name):
            still[name].pop()
        elif close:
            tags[-1][1] = None
    for at in (k for v in still.values() for k in v):
        tags[at][1] = 0
    out, around = [], []
    for name, way in tags:
        if way == -1:
            out[around.pop()][3] = len(out) - 1
        elif way is not None:
            out.append([name, len(out), len(around), len(out), around[-1] if around else None])
            if way:
                around.append(len(out) - 1)
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = markup.with_ancestors(markup.page_nodes(spark.createDataFrame(PAGES, "page_id long, html string")))
    return rows.persist()


def test_brackets_are_a_stack(spark, sf, nodes):
    def of(rows):
        out = {}
        for r in rows.collect():
            out.setdefault(r["tree_id"], []).append((r["kind"], r["node_id"], r["depth"], r["sub_end"], r["parent_id"]))
        return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}

    assert of(nodes) == {k: stack(h) for k, h in PAGES if stack(h)}
    given = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert of(page_tree(spark, sf)) == {k: stack(h) for k, h in given}


def test_ancestors_and_deep_paths(nodes):
    anc = {(r["tree_id"], r["node_id"]): r["anc"] for r in nodes.collect()}
    for t, html in PAGES:
        parents = {n: p for _, n, _, _, p in stack(html)}
        for n in parents:
            chain, up = [], parents[n]
            while up is not None:
                chain.insert(0, up)
                up = parents[up]
            assert anc[t, n] == chain
    deep = path(nodes.filter("tree_id = 7 and node_id = 0"), nodes, [Step("descendant", "p"), Step("ancestor", "div")], carry=("node_id",))
    assert deep.count() == 300


def test_carried_columns_may_have_a_nodes_name(nodes):
    rows = path(nodes.filter("tree_id = 1 and kind = 'ul'"), nodes, [Step("child", "li"), Step("parent")], carry=("kind", "depth"))
    assert {(r["kind"], r["depth"]) for r in rows.collect()} == {("ul", 2)} and "_carry_0" not in rows.columns


def test_numbers_from_links(spark, sf, nodes):
    links = nodes.select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), F.col("node_id").alias("place"))
    got = {(r["tree_id"], r["node"]): (r["node_id"], r["sub_end"], r["depth"], r["parent_id"]) for r in forest_numbers(links, "place").collect()}
    assert got == {(r["tree_id"], r["node_id"]): (r["node_id"], r["sub_end"], r["depth"], r["parent_id"]) for r in nodes.collect()}


def test_sales_tree_from_links(spark, sf):
    n = numbered(sales_rows(spark, sf), "tree_id", ["c", "o"])
    # keys of a level, dealt to one numbering: a node's own number is its pre-order rank backwards
    total = n.groupBy("tree_id").agg(F.count("*").alias("all"))
    own = n.join(total, "tree_id")
    links = own.select("tree_id", (F.col("all") - F.col("node_id")).alias("node"), (F.col("all") - F.col("parent_id")).alias("parent"), F.col("node_id").alias("place"))
    got = forest_numbers(links, "place").join(total, "tree_id")
    assert got.filter("all - node <> node_id").count() == 0
    want = n.select("tree_id", "node_id", "sub_end", "depth", "parent_id")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_long_chain(spark):
    c = spark.range(10_000).select(F.lit(1).cast("long").alias("tree_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    n = forest_numbers(c.select("tree_id", F.col("id").alias("node"), "parent", F.col("id").alias("place")), "place")
    assert n.filter("node = node_id and sub_end = 9999 and depth = node").count() == 10_000
    short = c.filter("id < 600").select("tree_id", F.col("id").alias("node_id"), F.col("parent").alias("parent_id"))
    assert ancestors(short).filter("size(anc) = node_id").count() == 600


def test_links_that_never_end(spark):
    loop = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree_id long, node_id long, parent_id long")
    with pytest.raises(Exception):
        ancestors(loop.withColumn("parent_id", F.expr("parent_id"))).count()


def test_nested_dumps(nodes):
    got = {(r["tree_id"], r["node_id"]): json.loads(r["dump"]) for r in nested(nodes, depth=2, most=2).collect()}
    assert got[7, 0] == {"kind": "div", "node": 0, "truncated": False, "children": [{"kind": "div", "node": 1, "truncated": False, "children": [{"kind": "div", "node": 2, "truncated": True, "children": []}]}]}
    body = got[1, 0]["children"][0]
    assert body["truncated"] and [c["kind"] for c in body["children"]] == ["p", "p"]


def test_tables_are_kept_by_file(spark, tmp_path):
    at = f"{tmp_path}/pages.parquet"
    schema = "page_id long, html string"
    spark.createDataFrame([(1, "<a></a>")], schema).coalesce(1).write.parquet(at)
    spark.createDataFrame([(2, "<b><i></i></b>")], schema).coalesce(1).write.mode("append").parquet(at)
    read = []

    def derive(pages):
        rows = pages.persist()
        read.append(rows.count())
        return rows.select("page_id", "file_key", F.length("html").alias("n"))

    def get():
        return sorted((r["page_id"], r["n"]) for r in store.by_file(spark, "t", at, derive).collect())

    assert get() == [(1, 7), (2, 14)] == get() and read == [2]
    spark.createDataFrame([(3, "<p>")], schema).coalesce(1).write.mode("append").parquet(at)
    assert get() == [(1, 7), (2, 14), (3, 3)] and read == [2, 1]  # one file is read
    import glob
    import os

    gone = [f for f in glob.glob(f"{at}/*.parquet") if spark.read.parquet(f).first()["page_id"] == 1]
    os.remove(gone[0])
    assert get() == [(2, 14), (3, 3)] and read == [2, 1]
    spark.createDataFrame([(9, "x")], schema).coalesce(1).write.mode("overwrite").parquet(at)
    assert get() == [(9, 1)] and read == [2, 1, 1]


def test_the_sales_tree_follows_its_tables(spark, sf, tmp_path):
    for t in ("nation", "customer", "orders"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    before = sales(spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf}/orders.parquet").limit(10).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    customers = spark.read.parquet(f"{sf}/customer.parquet").count()
    assert before > sales(spark, str(tmp_path)).count() == 25 + customers + 10
