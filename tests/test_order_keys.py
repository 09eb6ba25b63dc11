import random

from treeline.operators.order_keys import insert_after, labelled, places
from treeline.operators.spans import overlaps


def test_inserts_over_versions_and_in_crowds(spark):
    rng = random.Random(4)
    want = {b: [f"{b}{k}" for k in range(4)] for b in "xyz"}
    rows = spark.createDataFrame([(b, i, k) for b, ids in want.items() for k, i in enumerate(ids)], "block string, id string, k int")
    rows = labelled(rows, "block", "k", gap=4).drop("k")  # little room: blocks get crowded
    for version in range(5):
        new = []
        for b, ids in want.items():
            for spot in rng.sample([None, *ids], 2):
                fresh = [f"{b}v{version}-{len(new)}-{j}" for j in range(rng.randrange(1, 4))]
                new += [(b, i, spot) for i in fresh]
                at = 0 if spot is None else ids.index(spot) + 1
                ids[at:at] = fresh
        new.append(("x", f"lost{version}", "nobody"))
        put = spark.createDataFrame(new, "block string, id string, after string")
        rows = spark.createDataFrame(insert_after(rows, put, "block", "id", gap=4).collect(), rows.schema)
        got = {}
        for r in places(rows, "block").collect():
            got.setdefault(r["block"], {})[r["place"]] = r["id"]
        assert {b: [x[k] for k in sorted(x)] for b, x in got.items()} == want


def test_untouched_blocks_keep_their_labels(spark):
    rows = labelled(spark.createDataFrame([("a", k) for k in range(3)] + [("b", k) for k in range(3)], "block string, id long"), "block", "id", gap=2)
    out = insert_after(rows, spark.createDataFrame([("a", 10, 0), ("a", 11, 0)], "block string, id long, after long"), "block", "id", gap=2)
    got = {(r["block"], r["id"]): r["label"] for r in out.collect()}
    assert [got["b", k] for k in range(3)] == [2, 4, 6]
    assert [got["a", k] for k in (0, 10, 11, 1, 2)] == [2, 4, 6, 8, 10]


def test_overlaps_of_short_and_endless_intervals(spark):
    rng = random.Random(6)
    some = lambda n: [(rng.choice("pq"), k, f, f + rng.choice([-1, 0, 3, 40, 3_000_000_000])) for k, f in enumerate(rng.randrange(-200, 200) for _ in range(n))]
    a, b = some(60), some(60)
    schema = "key string, id long, first long, last long"
    for width in (1, 64):
        rows = overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "key", width).collect()
        want = sorted((k, i, j) for k, i, f, e in a for m, j, g, h in b if k == m and f <= e and g <= h and f <= h and g <= e)
        assert sorted((r["key"], r["a"], r["b"]) for r in rows) == want
    assert overlaps(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), "key").collect() == []
