from pyspark.sql import functions as F
from treeline.functions import holds_sql, named
from treeline.operators.flow import control_flow
from treeline.operators.graph import members_of


def test_sql_strings_and_names(spark):
    df = spark.createDataFrame([(1, "select a\nfrom t"), (2, "selected from"), (3, "DELETE  FROM t"), (4, None), (5, "Update t SET x")], "id long, s string")
    assert [r["id"] for r in df.filter(holds_sql(F.col("s"))).orderBy("id").collect()] == [1, 3, 5]
    codes = spark.createDataFrame([("a",), ("b",), (None,)], "c string").select(named(F.col("c"), {"a": "public"}).alias("n"))
    assert [r["n"] for r in codes.collect()] == ["public", "unknown", "unknown"]


def test_control_flow(spark):
    rows = [("m", 1, "if"), ("m", 2, "return"), ("m", 3, "call"), ("k", 1, "return"), ("k", 2, "throw"), ("e", 1, None)]
    df = spark.createDataFrame(rows, "region string, at long, kind string")
    got = {r["region"]: tuple(r)[1:] for r in control_flow(df, "region", ("at",), "kind", ("return",), ("throw",)).collect()}
    assert got == {"m": (1, "return", True), "k": (1, "return,throw", False), "e": (0, "", True)}
    assert control_flow(df.limit(0), "region", ("at",), "kind", ("return",)).collect() == []


def test_members_of_derived(spark):
    derived = spark.createDataFrame([("A", "B"), ("A", "C")], "base string, derived string")
    members = spark.createDataFrame([("A", "run"), ("A", "run"), ("B", "run"), ("B", "stop"), ("C", "stop"), ("A", None), ("B", None)], "owner string, member string")
    assert [tuple(r) for r in members_of(derived, members).collect()] == [("A", "B", "run")]
