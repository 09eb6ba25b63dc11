import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from treeline.functions import added_after, as_task, modifiers, summary, unquoted, wildcard_replaced
from treeline.operators.flow import region_sets
from treeline.operators.graph import reach
from treeline.operators.paths import At, Has, Step, kth_siblings, limited, node_paths, path
from treeline.operators.steps import attributes, differs, edge_wildcard, is_true
from treeline.plans.members import workspace_files
from treeline.sources.files import files, language, texts, workspace
from treeline.streaming.markers import mark

# r(0) has a(1), b(4), c(5); a has a1(2), a2(3); c has c1(6); c1 has x(7)
ROWS = [(0, None, 7, "r", []), (1, 0, 3, "a", [0]), (2, 1, 2, "a1", [0, 1]), (3, 1, 3, "a2", [0, 1]), (4, 0, 4, "b", [0]), (5, 0, 7, "c", [0]), (6, 5, 7, "c1", [0, 5]), (7, 6, 7, "x", [0, 5, 6])]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(t, *r[:4], len(r[4]), r[4]) for t in (1, 2) for r in ROWS]
    return spark.createDataFrame(rows, "tree_id int, node_id long, parent_id long, sub_end long, kind string, depth int, anc array<long>")


def ids(df):
    return sorted(r["node_id"] for r in df.filter("tree_id = 1").collect())


def test_paths_fold_steps(nodes):
    top = nodes.filter("kind = 'r'")
    assert ids(path(top, nodes, [Step("child"), Step("child")])) == [2, 3, 6]
    assert ids(path(top, nodes, [Step("descendant", None, (Has((Step("child", "x"),)),))])) == [6]
    assert ids(path(top, nodes, [Step("child", None, (Has((Step("child"),), negate=True),))])) == [4]
    assert ids(path(top, nodes, [Step("child", None, (Has((Step("descendant"),)), At(2)))])) == [5]
    assert ids(path(top, nodes, [Step("child", None, (At(1, last=True), F.col("kind") == "c")), Step("descendant")])) == [6, 7]
    assert ids(path(nodes.filter("kind = 'x'"), nodes, [Step("ancestor", None, (At(1),))])) == [6]
    assert ids(path(nodes.filter("kind = 'x'"), nodes, [Step("ancestor", None, (At(1, last=True),))])) == [0]
    up = [Step("parent"), Step("child", None, (At(1),))]
    leaves = nodes.filter("kind in ('a1', 'a2')")
    assert ids(path(leaves, nodes, up)) == [2, 2] and ids(path(leaves, nodes, up, distinct=True)) == [2]
    assert ids(path(top, nodes, [Step("child", "nothing")])) == [] == ids(path(top.limit(0), nodes, up))


def test_places_of_nodes(nodes):
    one = nodes.filter("tree_id = 1")
    assert {r["node_id"]: (r["earlier"], r["later"]) for r in kth_siblings(one, "kind", 1).filter("parent_id = 0").collect()} == {1: (None, "b"), 4: ("a", "c"), 5: ("b", None)}
    got = {r["node_id"]: (r["children"], r["truncated"]) for r in limited(one, 1).collect()}
    assert got == {0: (3, False), 1: (2, True), 4: (0, False), 5: (1, True)}
    assert {r["node_id"] for r in limited(one, 1, base=2).collect()} == {2, 3, 6, 7}
    label = F.concat("kind", F.lit("["), "ordinal", F.lit("]"))
    assert [r["path"] for r in node_paths(one.filter("kind = 'x'"), nodes, label).collect()] == ["/r[1]/c[1]/c1[1]/x[1]"]


def test_predicates_and_attributes(spark):
    df = spark.createDataFrame([("Abc", "TRUE", None), (None, None, "z"), ("xyz", "no", "y")], "a string, b string, c string")
    row = df.select(differs(F.col("a"), "ABC"), is_true(F.col("b")), edge_wildcard(F.col("a"), "*C"), edge_wildcard(F.col("a"), "a*"), edge_wildcard(F.col("a"), "*Y*"), edge_wildcard(F.col("a"), "ab")).collect()
    assert [tuple(r) for r in row] == [(False, True, True, True, False, False), (False, False, False, False, False, False), (True, False, False, False, True, False)]
    assert [r["m"] for r in df.select(attributes(df, "a", "c", "none").alias("m")).collect()] == [{"a": "Abc"}, {"c": "z"}, {"a": "xyz", "c": "y"}]


def test_texts_of_members(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(modifiers(F.array(F.lit("Public"), F.lit("Shared")), {"shared": "static"})) == "public static"
    assert one(unquoted(F.lit('"a"b"'))) == 'a"b' and one(unquoted(F.lit("ab"))) == "ab"
    assert one(wildcard_replaced(F.lit("get.Name()"), "get.*()", "$*_")) == "$Name_" and one(wildcard_replaced(F.lit("other"), "get*", "*")) == "other"
    assert [one(as_task(F.lit(x))) for x in ("void", "int", "Task<int>")] == ["Task", "Task<int>", "Task<int>"]
    assert one(added_after(F.lit("a{b{"), "{", "+")) == "a{+b{" and one(added_after(F.lit("ab"), "{", "+")) == "ab+"
    assert one(summary(F.lit("<s> a\n  b </s>"), "s")) == "a b" and one(summary(F.lit("none"), "s")) == ""


def test_regions(spark):
    rows = [("in", 1, True), ("in", 5, False), ("out", 5, True), ("out", 9, False), ("over", 1, True), ("over", 5, True), ("over", 6, False), ("far", 1, False)]
    got = {r["var"]: tuple(r)[1:] for r in region_sets(spark.createDataFrame(rows, "var string, pos long, is_write boolean"), 4, 7).collect()}
    assert got == {"in": (True, False, True, False, False), "out": (False, True, False, True, True), "over": (True, True, False, False, False)}


def test_reach_without_a_depth_ends(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in reach(spark.createDataFrame([(0,)], "node int"), edges).collect()}
    assert got == {i: i for i in range(1, 13)}


def test_files_and_workspaces(spark, sf, tmp_path):
    for name in ("b/x.cs", "a/y.CS", "a/obj/z.cs", "a/notes.txt", "w.fsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}\nend")
    root = f"file://{tmp_path}"
    got = files(spark, root, "*.[cC][sS]")
    assert [r["path"].removeprefix(f"file:{tmp_path}/") for r in got.collect()] == ["a/y.CS", "b/x.cs"]
    assert [r[0] for r in got.select(language(F.col("path"))).collect()] == ["C#", "C#"]
    assert {r["text"] for r in texts(spark, root, "*.fsx").collect()} == {"text of w.fsx\nend"}
    tables = {x: os.path.getsize(f"{sf}/{x}") for x in os.listdir(sf) if x.endswith(".parquet")}
    assert {r["path"].split("/")[-1]: r["bytes"] for r in files(spark, sf, "*.parquet").collect()} == tables
    assert {r["name"]: r["n_rows"] for r in workspace_files(spark, sf).collect()} == {x: pq.read_metadata(f"{sf}/{x}").num_rows for x in tables}
    (tmp_path / "none").mkdir()
    pq.write_table(pq.read_table(f"{sf}/region.parquet"), tmp_path / "none" / "other.parquet")
    assert workspace_files(spark, f"file://{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([("1", "/Src/B"), ("2", "/src/a"), ("3", None)], "id string, path string")
    chosen = lambda w: sorted(r["id"] for r in workspace(rows, "id", "path", w).collect())
    assert chosen("3") == ["3"] and chosen("/SRC") == ["1"] and chosen("/src/a") == ["2"] and chosen("nothing") == ["1", "2", "3"] == chosen(None)


def test_capped_markers(spark):
    rows = spark.range(5).selectExpr("1 as s", "id as k")
    assert [r["marker"] for r in mark(rows, "s", "k", most=2).orderBy("k").collect()] == ["mark-1", "mark-2"]
