import pytest
from pyspark.sql import functions as F
from treeline.operators.graph import reach
from treeline.operators.steps import exists, holds, position, same, step, test as true, wildcard
from treeline.streaming import sessions

# r(0) has a(1), b(4), c(5); a has a1(2), a2(3); c has c1(6); c1 has x(7)
ROWS = [(0, None, 7, "r"), (1, 0, 3, "a"), (2, 1, 2, "a1"), (3, 1, 3, "a2"), (4, 0, 4, "b"), (5, 0, 7, "c"), (6, 5, 7, "c1"), (7, 6, 7, "x")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(1, *r) for r in ROWS] + [(2, *r) for r in ROWS], "tree_id int, node_id long, parent_id long, sub_end long, kind string")


@pytest.mark.parametrize(
    "at,axis,want",
    [
        (2, "following-sibling", [3]), (5, "preceding-sibling", [1, 4]), (1, "following", [2, 3, 4, 5, 6, 7]), (4, "following", [5, 6, 7]), (3, "following", []),
        (5, "preceding", [1, 2, 3, 4]), (7, "ancestor", [0, 5, 6]), (7, "ancestor-or-self", [0, 5, 6, 7]), (1, "descendant-or-self", [1, 2, 3]), (1, "child", [2, 3]),
        (0, "parent", []), (0, "following", []), (0, "preceding", []), (0, "following-sibling", []), (0, "descendant", [1, 2, 3, 4, 5, 6, 7]), (4, "self", [4]),
    ],
)
def test_axes(nodes, at, axis, want):
    got = step(nodes.filter(f"tree_id = 1 and node_id = {at}"), nodes, axis).orderBy("node_id").collect()
    assert [r["node_id"] for r in got] == want and all(r["tree_id"] == 1 for r in got)


def test_steps_are_multisets(nodes):
    assert step(step(nodes, nodes, "self"), nodes, "descendant-or-self").filter("tree_id = 1").count() == 20


def test_exists_and_positions(nodes):
    one = nodes.filter("tree_id = 1")
    assert {r["kind"] for r in exists(one, nodes, "child").collect()} == {"r", "a", "c", "c1"}
    assert {r["kind"] for r in exists(one, nodes, "descendant", "x", negate=True).collect()} == {"a", "a1", "a2", "b", "x"}
    assert [r["kind"] for r in position(one, 1, ["tree_id"], True).collect()] == ["x"]
    assert position(one, 99, ["tree_id"]).count() == 0


def test_predicates_are_two_valued(spark):
    df = spark.createDataFrame([("Abc",), (None,), ("x.c",)], "a string")
    row = df.select(same(F.col("a"), "ABC").alias("s"), (~holds(F.col("a"), "b")).alias("h"), wildcard(F.col("a"), "?.c").alias("w"), true(F.col("a") > "b").alias("t")).collect()
    assert [tuple(r) for r in row] == [(True, False, False, False), (False, True, False, False), (False, True, True, True)]


def test_reach_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in reach(spark.createDataFrame([(1,)], "node int"), edges, 3).collect()}
    assert got == {2: 1, 3: 2, 4: 3}


def test_sessions_of_a_stream_are_those_of_the_batch(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.write.mode("overwrite").parquet(path)
    stream = sessions(spark.readStream.schema(batch.schema).parquet(path), late="100 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions_out").collect())) == sorted(map(tuple, sessions(batch).collect()))
