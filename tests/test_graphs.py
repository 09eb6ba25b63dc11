import random
import time

import pytest
from pyspark.sql import functions as F
from treeline.operators.flow import always_assigned, conditional_assignments, unreachable
from treeline.operators import graph
from treeline.sources import folders
from treeline.operators.graph import call_tree, condensed, distances, reach, reachable_counts


def closure(edges):
    """(src, dst) -> least number of edges, by breadth."""
    out, on = {}, {}
    for a, b in edges:
        on.setdefault(a, set()).add(b)
    for start in on:
        front, d = {start}, 0
        while front:
            d += 1
            front = {b for a in front for b in on.get(a, ()) if (start, b) not in out and b != start}
            out.update(dict.fromkeys(((start, b) for b in front), d))
    return out


def some_edges(seed, n=40, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_components(spark, seed):
    edges = some_edges(seed) + [(100 + k, 100 + (k + 1) % 9) for k in range(9)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = closure(edges)
    assert {(r["src"], r["dst"]): r["depth"] for r in distances(df).collect()} == want
    names, pairs = condensed(df)
    nodes = {x for e in edges for x in e}
    of = {n: min([n] + [b for b in nodes if (n, b) in want and (b, n) in want]) for n in nodes}
    assert {r["node"]: r["component"] for r in names.collect()} == of
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == {(of[a], of[b]) for a, b in want if of[a] != of[b]}
    assert {r["node"]: r["reaches"] for r in reachable_counts(df).collect()} == {n: sum((n, b) in want for b in nodes) for n in nodes}


def test_reach_to_a_depth_is_breadth_first(spark):
    edges = some_edges(3)
    df, starts = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,), (2,), (2,)], "node long")
    for depth in (1, 3, None):
        got = {(r["start"], r["node"]): r["depth"] for r in reach(starts, df, depth).collect()}
        assert got == {k: d for k, d in closure(edges).items() if k[0] in (1, 2) and (depth is None or d <= depth)}


def test_a_deep_chain_takes_few_rounds(spark):
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    began = time.time()
    assert reach(spark.createDataFrame([(0,)], "node long"), chain).agg(F.max("depth")).first()[0] == 60
    assert time.time() - began < 30


def test_call_tree(spark):
    edges = [(1, 2, 10), (1, 3, 20), (2, 4, 1), (2, 1, 2), (3, 4, 1), (3, 5, 2), (4, 5, 1), (5, 2, 1), (2, 2, 3)]

    def brute(start, depth):
        """Levels in turn, calls in order; what a level calls first is opened."""
        opened, front, lines = {start: ()}, [(start, ())], []
        for d in range(1, depth + 1):
            calls = sorted((p + (at,), s, t) for n, p in front for s, t, at in edges if s == n)
            front = []
            for p, s, t in calls:
                again = t in opened
                if not again:
                    opened[t] = p
                    front.append((t, p))
                lines.append((p, d, s, t, again))
        return [(k, *x[1:]) for k, x in enumerate(sorted(lines), 1)]

    df = spark.createDataFrame(edges, "src long, dst long, at long")
    rows = call_tree(spark.createDataFrame([(1,), (3,)], "node long"), df, 4).collect()
    for start in (1, 3):
        assert sorted((r["line"], r["depth"], r["src"], r["dst"], r["again"]) for r in rows if r["start"] == start) == brute(start, 4)


def tree(spec):
    """Nested tuples (role, var or None, children...) -> block rows and assignments, numbered in order."""
    rows, sets = [], []

    def walk(x, up):
        me = len(rows)
        rows.append((1, me, up[-1] if up else None, list(up), x[0]))
        if x[1]:
            sets.append((1, me, x[1]))
        for child in x[2:]:
            walk(child, [*up, me])

    walk(spec, [])
    return rows, sets


def sure(rows, sets, me):
    out = {v for _, n, v in sets if n == me}
    children = [r[1] for r in rows if r[2] == me]
    parts = [sure(rows, sets, c) for c in children]
    role = rows[me][4]
    if parts and role == "seq":
        out |= set.union(*parts)
    elif parts and role == "branch":
        out |= set.intersection(*parts)
    return out


def below(rows, sets, me):
    return {v for _, n, v in sets if n == me or me in rows[n][3]}


def random_tree(rng, depth=5):
    role = rng.choice(["seq", "seq", "branch", "loop"])
    children = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))] if depth else []
    return (role, rng.choice([None, "x", "y", "z"]), *children)


@pytest.mark.parametrize("seed", range(3))
def test_assignments_and_reachability(spark, seed):
    rows, sets = tree(("seq", None, ("branch", None, ("seq", "x"), ("branch", None, ("seq", "x"), ("seq", None, ("seq", "x"), ("loop", None, ("seq", "y"))))), random_tree(random.Random(seed)), random_tree(random.Random(seed + 10))))
    blocks = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, anc array<long>, role string")
    marks = spark.createDataFrame(sets, "tree_id long, node_id long, var string")
    want = {(n, v) for _, n, _, _, _ in rows for v in sure(rows, sets, n)}
    assert {(r["node_id"], r["var"]) for r in always_assigned(blocks, marks).collect()} == want
    maybe = {(n, v) for _, n, _, _, _ in rows for v in below(rows, sets, n)}
    assert {(r["node_id"], r["var"]) for r in conditional_assignments(blocks, marks).collect()} == maybe - want
    exits = [s for s in sets if s[2] == "z"]
    stuck, dead = unreachable(blocks, marks.filter("var = 'z'"))
    stops = {n for _, n, _, _, _ in rows if sure(rows, exits, n)}
    assert {r["node_id"] for r in stuck.collect()} == stops
    gone = set()
    for _, n, up, anc, _ in rows:
        if n in gone or any(a in gone for a in anc) or (up is not None and rows[up][4] != "branch" and any(r[2] == up and r[1] < n and r[1] in stops for r in rows)):
            gone.add(n)
    assert {r["node_id"] for r in dead.collect()} == gone


@pytest.mark.parametrize("rounds", [64, 2])
def test_components_around_pivots(spark, monkeypatch, rounds):
    """A large component with ways in and out is one node before pairs are composed; with too few rounds pairs find the rest."""
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    edges = [(k, (k + 1) % 12) for k in range(12)] + [(0, 6), (6, 3), (20, 21), (21, 1), (5, 30), (30, 31), (31, 30), (40, 41)]
    names, pairs = condensed(spark.createDataFrame(edges, "src long, dst long"))
    of = {r["node"]: r["component"] for r in names.collect()}
    assert of == {**{k: 0 for k in range(12)}, 20: 20, 21: 21, 30: 30, 31: 30, 40: 40, 41: 41}
    assert sorted((r["src"], r["dst"]) for r in pairs.collect()) == [(0, 30), (20, 0), (20, 21), (20, 30), (21, 0), (21, 30), (40, 41)]


def test_a_component_is_found_without_pairs(spark):
    ways = graph.on_ways(spark.createDataFrame([(k, (k + 1) % 12) for k in range(12)] + [(20, 0), (5, 30)], "src long, dst long"))
    assert ways.count() == 12 and {(r["node"], r["least"]) for r in graph.around_pivots(ways).collect()} == {(k, 0) for k in range(12)}


@pytest.mark.parametrize("rounds,rows", [(128, 1 << 18), (128, 8), (2, 1 << 18)])
def test_counts_list_no_pairs_through_a_hub(spark, monkeypatch, rounds, rows):
    """What a large component leads to is counted once for all that lead to it; with too few rounds all pairs are listed. Small parts, too."""
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    monkeypatch.setattr(folders, "ROWS", rows)
    if rounds > 2:
        monkeypatch.setattr(graph, "distances", None)  # lists all pairs
    ring = [(k, (k + 1) % 12) for k in range(12)]
    ways = [(20, 21), (21, 1), (22, 1), (23, 21), (5, 30), (30, 31), (31, 30), (30, 32), (7, 33), (22, 40), (40, 33), (40, 41), (50, 50), (23, 42), (42, 43), (60, 23), (61, 41)]
    edges = ring + ways + [(100 + a, 100 + b) for a, b in some_edges(9, 50, 60)]
    want, nodes = closure(edges), {x for e in edges for x in e}
    rows = reachable_counts(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["reaches"] for r in rows} == {n: sum((n, b) in want for b in nodes) for n in nodes}
    assert {r["node"]: r["component"] for r in rows} == {n: min([n] + [b for b in nodes if (n, b) in want and (b, n) in want]) for n in nodes}
