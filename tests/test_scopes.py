import random
import re

import pytest
from pyspark.sql import functions as F
from treeline.operators.scopes import meant, visible
from treeline.operators.splice import accepted, segments, spans_of, splice
from treeline.streaming.eviction import event_stream, evicted, run_available

TREE = "tree_id long, node_id long, anc array<long>, kind string, name string"
#: { x { x y } use } by order: blocks b, declarations d, uses u.
ROWS = [
    (1, 0, [], "b", None), (1, 1, [0], "d", "x"), (1, 2, [0], "u", "x"), (1, 3, [0], "b", None), (1, 4, [0, 3], "u", "x"), (1, 5, [0, 3], "d", "x"), (1, 6, [0, 3], "d", "y"), (1, 7, [0, 3], "d", "x"),
    (1, 8, [0, 3], "u", "x"), (1, 9, [0, 3], "u", "z"), (1, 10, [0], "u", "x"), (1, 11, [0], "u", "y"), (1, 12, [0], "d", "y"), (1, 13, [], "u", "x"), (2, 0, [], "b", None), (2, 1, [0], "u", "x"),
]


def test_shadowing_and_what_a_rename_touches(spark):
    n = spark.createDataFrame(ROWS, TREE)
    uses, decls, scopes = (n.filter(F.col("kind") == k) for k in "udb")
    got = {(r["tree_id"], r["node_id"]): r["decl"] for r in meant(uses, decls, scopes).collect()}
    assert got == {(1, 2): 1, (1, 4): 1, (1, 8): 7, (1, 9): None, (1, 10): 1, (1, 11): None, (1, 13): None, (2, 1): None}
    seen = {(r["node_id"], r["name"], r["decl"]) for r in visible(uses.filter("tree_id = 1"), decls, scopes).collect()}
    assert {x for x in seen if x[0] == 9} == {(9, "x", 7), (9, "y", 6)} and {x for x in seen if x[0] == 11} == {(11, "x", 1)}
    assert {(r["node_id"], r["name"]) for r in visible(uses, decls, scopes, 1).collect() if r["node_id"] == 9} == {(9, "x")}


def spliced(text, edits):
    """Edits in order; one that begins before the end of an earlier one is refused."""
    out, at, end, refused = "", 0, 0, 0
    for start, length, new, _ in sorted(edits, key=lambda e: (e[0], -e[1], e[3], e[2])):
        if start < end:
            refused += 1
        else:
            out += text[at:start] + new
            at = start + length
        end = max(end, start + length)
    return out + text[at:], refused


@pytest.mark.parametrize("seed", [1, 2])
def test_splices_are_edits_in_order(spark, seed):
    rng = random.Random(seed)
    texts = [(k, "".join(rng.choice("abé \n日") for _ in range(rng.randrange(60)))) for k in range(30)] + [(99, None), (98, "stays")]
    edits = [(k, s, rng.randrange(min(6, len(t) - s) + 1), rng.choice(["", "N", "longer"]), rng.randrange(2)) for k, t in texts[:30] for s in (rng.randrange(len(t) + 1) for _ in range(rng.randrange(6)))]
    edits = sorted(set(edits))
    df = spark.createDataFrame(texts, "id long, text string")
    e = spark.createDataFrame(edits, "id long, start long, length long, new string, rank int")
    got = {r["id"]: (r["spliced"], r["n_refused"]) for r in splice(df, e).collect()}
    assert got == {k: (None, 0) if t is None else spliced(t, [x[1:] for x in edits if x[0] == k]) for k, t in texts}
    # what stays stands where the table says
    text = dict(texts)
    for r in segments(df, e, "id").collect():
        assert text[r["id"]][r["start"] : r["start"] + r["length"]] == got[r["id"]][0][r["moved"] : r["moved"] + r["length"]]
    for r in accepted(e).filter("fits").collect():
        assert got[r["id"]][0][r["moved"] :].startswith(r["new"])


def test_spans_of_matches(spark):
    texts = [(1, "xx a xa"), (2, ""), (3, None), (4, "x")]
    rows = spans_of(spark.createDataFrame(texts, "k long, t string"), "k", "t", "x+", F.lit("y")).collect()
    assert sorted((r["id"], r["start"], r["length"]) for r in rows) == [(k, m.start(), len(m.group())) for k, t in texts for m in re.finditer("x+", t or "")]


def test_sessions_end_by_timers_and_go_on_after_a_stop(spark, tmp_path):
    minute = 60_000_000
    events = [(u, (60 + m) * minute) for u in (1, 2) for m in (0, 5, 19, 40, 54, 55, 200, 220)] + [(3, 70 * minute), (3, 71 * minute), (4, 360 * minute)]
    home, sink, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))

    def put(rows):
        df = spark.createDataFrame(rows, "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(home)

    put([e for e in events if e[1] < 110 * minute])
    run_available(evicted(event_stream(spark, home), late="1 minute"), sink, state)
    first = spark.read.parquet(sink).count()
    put([e for e in events if 110 * minute <= e[1] < 270 * minute])
    run_available(evicted(event_stream(spark, home), late="1 minute"), sink, state)  # as after a stop
    put([e for e in events if e[1] >= 270 * minute])
    run_available(evicted(event_stream(spark, home), late="1 minute"), sink, state)
    got = sorted((r["user_id"], r["started"] // minute - 60, r["n"]) for r in spark.read.parquet(sink).collect())
    assert got == [(u, s, n) for u in (1, 2) for s, n in ((0, 3), (40, 3), (200, 1), (220, 1))] + [(3, 10, 2)]  # the last one of user 4 is open
    assert 0 < first < len(got)
