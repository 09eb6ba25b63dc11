import pytest
from pyspark.sql import functions as F
from treeline.functions import after, before, is_identifier, renamed, shortened
from treeline.operators import edits
from treeline.operators.spans import innermost, inside, nearest, overlaps
from treeline.streaming.markers import cleared, find, mark, unmark

# r(0) has a(1), b(4); a has a(2), which has x(3)
ROWS = [(1, 0, None, 4, "r"), (1, 1, 0, 3, "a"), (1, 2, 1, 3, "a"), (1, 3, 2, 3, "x"), (1, 4, 0, 4, "b")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, "tree_id int, node_id long, parent_id long, sub_end long, kind string")


def test_regions_and_points(nodes):
    assert {r["node_id"] for r in inside(nodes, 1, 3).collect()} == {1, 2, 3}
    assert [r["node_id"] for r in innermost(nodes, 2).collect()] == [2]
    assert innermost(nodes, 9).collect() == []


def test_nearest_takes_the_closest_and_gives_null_where_there_is_none(spark):
    rows = [(1, 0, [], "r"), (1, 1, [0], "a"), (1, 2, [0, 1], "a"), (1, 3, [0, 1, 2], "x"), (1, 4, [0], "b")]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id long, anc array<long>, kind string")
    assert {r["node_id"]: r["found"] for r in nearest(nodes, nodes, "a").collect()} == {0: None, 1: None, 2: 1, 3: 2, 4: None}


def test_overlaps_equal_brute_force_and_come_once(spark):
    rows = [(i % 2, i, (i * 37) % 50, (i * 37) % 50 + (i * 13) % 40 - 1) for i in range(60)] + [(0, 99, -20, 200), (None, 98, 0, 5)]
    frame = spark.createDataFrame(rows, "k int, id long, first long, last long")
    want = sorted((k, a, b) for k, a, f, l in rows for j, b, g, m in rows if k == j and k is not None and f <= l and g <= m and max(f, g) <= min(l, m))
    assert sorted(tuple(r) for r in overlaps(frame, frame, "k", 7).collect()) == want


def test_edits(spark):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 1, None)], "block string, at long, s string")
    new = spark.createDataFrame([("p", 1, "n")], rows.schema)
    seen = lambda f: sorted((r["block"], r["at"], r["s"] or "") for r in f.collect())
    assert seen(edits.insert(rows, new, "block", "at")) == [("p", 1, "a"), ("p", 2, "n"), ("p", 3, "b"), ("q", 1, "")]
    assert seen(edits.insert(rows, new, "block", "at", after=False)) == [("p", 1, "n"), ("p", 2, "a"), ("p", 3, "b"), ("q", 1, "")]
    assert seen(edits.remove(rows, new, "block", "at")) == [("p", 1, "b"), ("q", 1, "")]
    assert seen(edits.replace(rows, new, "block", "at", "s")) == [("p", 1, "n"), ("p", 2, "b"), ("q", 1, "")]


def test_markers(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "s int, k long")
    marks = mark(rows, "s", "k", "here")
    left = unmark(marks, marks.filter("marker = 'mark-1'"), "s")
    assert [(r["s"], r["k"], r["marker"], r["label"]) for r in find(left, rows, "s", "k").collect()] == [(1, 11, "mark-2", "here")]
    assert {r["s"]: r["cleared"] for r in cleared(marks, "s").collect()} == {1: 2, 2: 1}


def test_strings(spark):
    x = F.col("x")
    row = lambda v: spark.createDataFrame([(v,)], "x string").select(before(x, "::"), after(x, "::"), shortened(x, 4), is_identifier(x, ("for",)), renamed(x, "of", "$1")).first()
    assert tuple(row("a::b::of")) == ("a", "b::of", "a::b...", False, "a::b::$1")
    assert tuple(row("for")) == ("", "", "for", False, "for")
    assert tuple(row("_of")) == ("", "", "_of", True, "_of")
