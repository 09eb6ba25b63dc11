import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_pages import PAGES
from treeline.operators.paths import At, Step, path
from treeline.operators.spans import spots_within
from treeline.sources import markup
from treeline.sources.places import around, attributes_of, contents, diagnostics, places, segments

LINES = [
    (11, "<html>\n<body>\n<p>one\n<b>two\nlines</b>\n\n</p>\n<p>left open\n</body></html>\nend"),
    (12, "a\n<br>\n</i>\n<ul><li\nclass='x'>é𝄞z</li>\n<li>last</ul>"),
    (13, "\n\n<i>\n<!-- gone\nfor ever --></i>"),
]
ALL = PAGES + LINES
TAG = r"""</?[A-Za-z][A-Za-z0-9-]*(?:[^>"']|"[^"]*"|'[^']*')*>"""


def bared(html):
    text = re.sub(r"(?s)<!--.*?-->", "", html or "")
    for name in markup.RAW:
        text = re.sub(rf"(?is)(<{name}\b[^>]*>).*?(</{name}\s*>)", r"\1\2", text)
    return text


def walk(html):
    """By a walk with a stack: elements as [begin, stop, line, last_line, content] and what is wrong as (code, name, begin, line)."""
    text, tags, still, wrong = bared(html), [], {}, []
    line_at = lambda at: 1 + text.count("\n", 0, at)
    for m in re.finditer(TAG, text):
        name, close = re.match(r"</?([A-Za-z][A-Za-z0-9-]*)", m[0])[1].lower(), m[0].startswith("</")
        void = name in markup.VOID
        if close and void:
            continue
        tags.append([m, -1 if close else 0 if void or m[0].endswith("/>") else 1, name])
        if tags[-1][1] == 1:
            still.setdefault(name, []).append(len(tags) - 1)
        elif close and still.get(name):
            still[name].pop()
        elif close:
            tags[-1][1] = None
            wrong.append(("stray", name, m.start(), line_at(m.start())))
    for at in (k for v in still.values() for k in v):
        tags[at][1] = 0
        wrong.append(("unclosed", tags[at][2], tags[at][0].start(), line_at(tags[at][0].start())))
    out, open_ = [], []
    for m, way, _ in tags:
        if way == -1:
            row = out[open_.pop()]
            row[1], row[3] = m.end(), line_at(m.end())
            row[4] = re.sub(TAG, "", text[row.pop() : m.start()])
        elif way is not None:
            out.append([m.start(), m.end(), line_at(m.start()), line_at(m.end()), "", m.end()])
            if way:
                open_.append(len(out) - 1)
    return [tuple(r[:5]) for r in out], sorted(wrong)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ALL, "page_id long, html string").persist()


def placed(pages):
    got = {}
    for r in contents(places(pages), pages).orderBy("tree_id", "node_id").collect():
        assert r["node_id"] == len(got.setdefault(r["tree_id"], []))
        got[r["tree_id"]].append((r["begin"], r["stop"], r["line"], r["last_line"], r["content"]))
    return got


def found(pages):
    got = {}
    for r in diagnostics(pages).collect():
        got.setdefault(r["tree_id"], []).append((r["code"], r["kind"], r["begin"], r["line"]))
    return {k: sorted(v) for k, v in got.items()}


def test_places_and_diagnostics_by_a_walk(spark, sf, pages):
    given_pages = spark.read.parquet(f"{sf}/pages.parquet")
    for rows, known in ((pages, ALL), (given_pages, [(r["page_id"], r["html"]) for r in given_pages.collect()])):
        walks = {k: walk(h) for k, h in known}
        assert placed(rows) == {k: w[0] for k, w in walks.items() if w[0]}
        assert found(rows) == {k: w[1] for k, w in walks.items() if w[1]}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<p>", "</p>", "<b\n>", "</b>", "<br>", "<i/>", "x", "\n", "é", "</br>", "<!--", "-->"]), max_size=14).map("".join), min_size=1, max_size=12))
def test_places_of_any_markup(spark, htmls):
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    walks = {k: walk(h) for k, h in enumerate(htmls)}
    assert placed(rows) == {k: w[0] for k, w in walks.items() if w[0]} and found(rows) == {k: w[1] for k, w in walks.items() if w[1]}


def test_lines_around(pages):
    b = places(pages).filter("tree_id = 11 and node_id = 3")
    got = [(r["line_no"], r["text"], r["hit"]) for r in around(b, pages, 1).orderBy("line_no").collect()]
    assert got == [(3, "<p>one", False), (4, "<b>two", True), (5, "lines</b>", True), (6, "", False)]
    first = around(places(pages).filter("tree_id = 11 and node_id = 0"), pages, 3)
    assert [r["line_no"] for r in first.orderBy("line_no").collect()] == list(range(1, 11))


def test_no_page_and_no_tag(spark, pages):
    none = pages.limit(0)
    for f in (places, segments, diagnostics):
        assert f(none).count() == 0 and f(pages.filter("page_id in (3, 4)")).count() == 0
    extra = pages.select("page_id", "html", F.lit(1).alias("tree_id"), F.lit(2).alias("line"))
    assert placed(extra) == placed(pages)


def test_attributes(spark):
    tags = ["<a href=\"/x?a=1&b='2'\" CLASS='big one' hidden data-n = 7>", "<br/>", "<p class=a class=b>", "<img src=\"a>b\" alt=\"\"/>", "<li\nid=q>", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(tags)], "k long, tag string").select("k", attributes_of(F.col("tag")).alias("x")).orderBy("k")
    got = [None if r["x"] is None else {a["name"]: a["value"] for a in r["x"]} for r in rows.collect()]
    assert got == [{"href": "/x?a=1&b='2'", "class": "big one", "hidden": "", "data-n": "7"}, {}, {"class": "a"}, {"src": "a>b", "alt": ""}, {"id": "q"}, None]


def test_positions_over_a_whole_step(spark):
    rows = [(1, 0, 9, None, [], "r"), (1, 1, 4, 0, [0], "u"), (1, 2, 2, 1, [0, 1], "l"), (1, 3, 3, 1, [0, 1], "l"), (1, 4, 4, 1, [0, 1], "l"), (1, 5, 7, 0, [0], "u"), (1, 6, 6, 5, [0, 5], "l"), (1, 7, 7, 5, [0, 5], "l"), (2, 0, 1, None, [], "u"), (2, 1, 1, 0, [0], "l")]
    n = spark.createDataFrame(rows, "tree_id long, node_id long, sub_end long, parent_id long, anc array<long>, kind string")
    lists = n.filter("kind = 'u'")
    at = lambda a, context=lists: sorted((r["tree_id"], r["node_id"]) for r in path(context, n, (Step("child", "l", (a,)),)).collect())
    assert at(At(1)) == [(1, 2), (1, 6), (2, 1)] and at(At(4, whole=True)) == [(1, 6)] and at(At(1, whole=True)) == [(1, 2), (2, 1)]
    assert at(At(1, last=True, whole=True)) == [(1, 7), (2, 1)] and at(At(9, whole=True)) == []
    assert at(At(2, whole=True), lists.unionByName(lists)) == [(1, 2), (2, 1)]  # found twice, counted twice


def test_spots_within_spans(spark):
    import random

    rng = random.Random(5)
    spans = [(t, k, a, a + rng.randint(-1, 12)) for t in (1, 2) for k, a in enumerate(rng.choices(range(30), k=20))]
    spots = [(t, rng.randint(-2, 40)) for t in (1, 3) for _ in range(40)]
    got = spots_within(spark.createDataFrame(spans, "tree_id long, span long, begin long, stop long"), spark.createDataFrame(spots, "tree_id long, at long"))
    assert {(r["tree_id"], r["span"]): r["n_spots"] for r in got.collect()} == {(t, k): sum(u == t and a <= x < b for u, x in spots) for t, k, a, b in spans}
