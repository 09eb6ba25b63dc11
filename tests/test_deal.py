"""Work is dealt by the size of the rows, not by that of their files."""

from treeline.sources import markup


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_tags_are_dealt_by_the_size_of_markup(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"<p>{'<b>x</b>' * 10}</p>") for k in range(40)], "page_id long, html string")
    assert markup.tasks_for(pages) == 1 and markup.tasks_for(pages.limit(0)) == 1
    monkeypatch.setattr(markup, "CHARS", 500)
    assert markup.tasks_for(pages) == 1 + 40 * 87 // 500
    nodes = markup.page_nodes(pages)
    assert plan(nodes).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(nodes)
    assert nodes.count() == 40 * 11
