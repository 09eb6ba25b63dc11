"""Rows are dealt to tasks by their number, not by the size of their files."""

from pyspark.sql import functions as F

from treeline.operators import flow, forest, graph, scopes
from treeline.plans.catalogue import QUERIES, families
from treeline.sources import folders, markup
from treeline.sources.trees import sales

PUT_TOGETHER = "spark.sql.adaptive.coalescePartitions.enabled"


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def joined(rows) -> str:
    """The lines of the plan below its last anti join."""
    return plan(rows).split("LeftAnti")[1]


def test_few_rows_are_left_to_spark(spark):
    rows = spark.range(40).select(F.col("id").alias("tree_id"))
    assert folders.tasks_for(spark, folders.ROWS) == 0 and folders.dealt(rows, 40, "tree_id") is rows
    assert folders.tasks_for(spark, 100 * folders.ROWS + 1) == 101


def test_settings_are_put_back(spark, monkeypatch):
    monkeypatch.setattr(folders, "ROWS", 10)
    names = ("spark.sql.shuffle.partitions", PUT_TOGETHER)
    before = [spark.conf.get(k) for k in names]
    try:
        with folders.dealing(spark, 95):
            assert [spark.conf.get(k) for k in names] == ["10", "false"]
            raise KeyError
    except KeyError:
        pass
    assert [spark.conf.get(k) for k in names] == before


def test_stored_rows_are_worked_in_tasks_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(folders, "ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 1500).alias("at"), F.lit(7).alias("one"))
    kept = folders.stored(rows.groupBy("at").agg(F.max("one").alias("one")), "dealing", 1500)
    assert kept.count() == 1500 and len(kept.inputFiles()) == 15


def test_the_sales_tree_and_its_siblings_are_dealt_by_rows(spark, sf, tmp_path, monkeypatch):
    want = {tuple(r) for r in QUERIES["path_preceding_sibling"](spark, sf).collect()}
    for t in ("nation", "customer", "orders"):  # another folder: nothing kept is used again
        spark.read.parquet(f"{sf}/{t}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    monkeypatch.setattr(folders, "ROWS", 100)
    n = sales(spark, str(tmp_path))
    assert len(n.filter("kind = 'order'").inputFiles()) > 10
    rows = QUERIES["path_preceding_sibling"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in plan(rows) and {tuple(r) for r in rows.collect()} == want
    assert "REPARTITION_BY_NUM" in plan(families(n))


def test_levels_of_reach_are_dealt_by_rows_and_seen_in_one_join(spark, sf, monkeypatch):
    monkeypatch.setattr(folders, "ROWS", 100)
    plans, put = [], graph.stored

    def watched(rows, name, n=None):
        plans.append((name, n, plan(rows)))
        return put(rows, name, n)

    monkeypatch.setattr(graph, "stored", watched)
    for name in ("callers_depth5", "callees_depth5"):
        want = [tuple(r) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()]
        per = {}
        for c, o in sorted(want, reverse=name == "callers_depth5"):
            per.setdefault(c, []).append(o)
        want = {(v[0], x, k) for v in per.values() for k, x in enumerate(v[:6]) if k}
        rows = QUERIES[name](spark, sf)
        assert {tuple(r) for r in rows.collect()} == want
    last = [(n, p) for name, n, p in plans if name == "level"][-1]
    assert last[0] > 1500 and last[1].count("LeftAnti") == 1 and "Broadcast" not in last[1]


def test_ancestors_and_steps_of_pages_are_dealt_by_rows(spark, sf, monkeypatch):
    want = {tuple(r) for r in QUERIES["page_without_text"](spark, sf).collect()}
    monkeypatch.setattr(folders, "ROWS", 100)
    rows = QUERIES["page_without_text"](spark, sf)
    assert "REPARTITION_BY_NUM" in joined(rows) and {tuple(r) for r in rows.collect()} == want
    nodes = folders.stored(markup.page_nodes(spark.read.parquet(f"{sf}/pages.parquet")), "dealing")
    assert "REPARTITION_BY_NUM" in plan(markup.with_ancestors(nodes))
    links = nodes.select("tree_id", F.col("node_id").alias("at"), F.col("parent_id").alias("next"), F.lit(1).alias("n"))
    ends = forest.doubled(links, "dealing", {"n": F.col("here.n") + F.col("there.n")})
    assert len(ends.inputFiles()) > 4 and ends.count() == nodes.count()


def test_what_blocks_assign_is_dealt_by_rows(spark, sf, monkeypatch):
    names = ("page_always_assigned", "page_conditional_assignments")
    want = {name: {tuple(r) for r in QUERIES[name](spark, sf).collect()} for name in names}
    monkeypatch.setattr(folders, "ROWS", 1000)
    asked, put = [], flow.stored

    def watched(rows, name, n=None):
        asked.append((name, n))
        return put(rows, name, n)

    monkeypatch.setattr(flow, "stored", watched)
    for name in names:
        rows = QUERIES[name](spark, sf)
        assert {tuple(r) for r in rows.collect()} == want[name] and want[name]
    assert "REPARTITION_BY_NUM" in joined(rows)
    assert {name for name, _ in asked} >= {"spans", "assigned", "arms", "branches", "below"} and all(n > 1000 for _, n in asked)


def test_uses_meet_their_declarations_in_turn(spark, sf, monkeypatch):
    want = {tuple(r) for r in QUERIES["page_rename_by_scope"](spark, sf).collect()}
    monkeypatch.setattr(folders, "ROWS", 100)
    plans, put = [], scopes.stored

    def watched(rows, name, n=None):
        plans.append((n, plan(rows)))
        return put(rows, name, n)

    monkeypatch.setattr(scopes, "stored", watched)
    rows = QUERIES["page_rename_by_scope"](spark, sf)
    assert {tuple(r) for r in rows.collect()} == want and want
    assert len(plans) == 1 and plans[0][0] > 100 and "Window" in plans[0][1]
