"""Closures of graphs: by breadth to a depth, by doubling to any depth, and of cyclic graphs by their components.

Every round is stored below the shared folder, which ends the lineage; none goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.folders import shuffled, stored, tasks_for


def reach(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """starts (node), edges (src, dst) -> (start, node, depth): all nodes within `depth` edges (None: any number), at their least depth."""
    if depth is None:
        of = starts.select(F.col("node").alias("src")).distinct()
        return distances(edges).join(of, "src", "left_semi").select(F.col("src").alias("start"), F.col("dst").alias("node"), "depth")
    edges = stored(edges.select("src", "dst"), "edges")
    n = edges.count()
    edges = stored(edges.distinct(), "edges", n)
    front = seen = stored(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)), "level", n)
    levels = [front]
    for d in range(1, depth + 1):
        after = front.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        after = after.join(shuffled(seen.select("start", "node")), ["start", "node"], "left_anti")
        front = stored(after.withColumn("depth", F.lit(d)), "level", n + sum(level.count() for level in levels))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front)
    out = levels[0].limit(0)
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def distances(edges: DataFrame) -> DataFrame:
    """src, dst, depth: the least number of edges between any two nodes of which one leads to the other.

    What is known up to k edges is known up to 2k after a round: a shortest path of more than k edges
    begins with one of exactly k. So a path of n edges takes log2(n) rounds.
    """
    known, k = stored(edges.filter("src <> dst").select("src", "dst", F.lit(1).alias("depth")).distinct(), "pairs"), 1
    while True:
        fresh = further(known, k)
        if fresh.isEmpty():
            return known
        known, k = stored(known.unionByName(fresh), "pairs"), 2 * k


def further(known: DataFrame, k: int) -> DataFrame:
    """Of known (src, dst, depth), complete up to k edges, the pairs from k + 1 to 2k."""
    far, on = known.filter(F.col("depth") == k), known.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("depth").alias("more"))
    met = far.join(on, "dst").filter("src <> end").groupBy("src", F.col("end").alias("dst")).agg(F.min(F.col("depth") + F.col("more")).alias("depth"))
    return stored(met.join(known.select("src", "dst"), ["src", "dst"], "left_anti"), "pairs")


#: Edges, at most, along which marks and nodes are passed on before all pairs are composed.
ROUNDS = 128
#: Edges that one job follows, of marks and of pairs.
HOPS, PAIR_HOPS = 8, 4


def together(rows: DataFrame, n: int) -> DataFrame:
    """The rows in one part if one task may hold n rows: what is joined with others of that kind is not shuffled."""
    return rows if tasks_for(rows.sparkSession, n) else rows.coalesce(1)


def at_hand(rows: DataFrame, n: int) -> DataFrame:
    """Rows that others are joined with step by step: sent to every task if one may hold n rows, which bounds what is sent, else dealt by key."""
    return shuffled(rows) if tasks_for(rows.sparkSession, n) else F.broadcast(rows)


def counted(rows: DataFrame, name: str, n: int, what: str = "true") -> tuple[DataFrame, int, int]:
    """stored(), how many rows there are, and of how many `what` is true: counted while they are written."""
    seen = Observation()
    out = stored(rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.expr(f"count_if({what})").alias("of")), name, n)
    return out, seen.get["rows"], seen.get["of"]


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def with_loops(edges: DataFrame, n: int) -> DataFrame:
    """edges and one from each node to itself, stored: what a node has stays with it when it is passed on, so that a step reads its state once."""
    return at_hand(stored(edges.select("src", "dst").unionByName(ends(edges).select(F.col("node").alias("src"), F.col("node").alias("dst"))), "ways", n), n)


def settled(marks: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """marks (node, mark) of all nodes of edges: each takes the greatest mark that leads to it within ROUNDS edges; whether more would change none."""
    on, own, rest = with_loops(edges, n), F.col("src") == F.col("dst"), False
    sent = (F.col("node") == F.col("src")) & (F.col("mark").isNotNull() & F.col("was").isNull() | (F.col("mark") > F.col("was")) | own)
    to, met = F.col("dst").alias("node"), [F.max("mark").alias("mark"), F.max(F.when(own, F.col("mark"))).alias("was")]
    marks = marks.select("node", "mark", F.lit(None).cast(marks.schema["mark"].dataType).alias("was"))
    for done in range(0, ROUNDS, HOPS):
        marks = together(marks, n)
        for _ in range(min(HOPS, ROUNDS - done)):
            marks = marks.join(on, sent).groupBy(to).agg(*met)
        marks, _, new = counted(marks, "marks", n, "mark > was")
        rest = not new
        if rest:
            break
    return marks.select("node", "mark"), rest


def on_ways(edges: DataFrame) -> DataFrame:
    """edges without those that are on no cycle, as nothing leads to their source or on from their end."""
    n = edges.count()
    for a, b in (("src", "dst"), ("dst", "src")):  # nodes that something leads to, then of these the ones that lead on
        live, left, on = ends(edges), None, at_hand(edges, n)
        for done in range(0, ROUNDS, HOPS):
            live = together(live, n)
            for _ in range(min(HOPS, ROUNDS - done)):
                live = live.join(on, F.col("node") == F.col(a)).groupBy(F.col(b).alias("node")).agg(F.lit(True))
            before = left
            live, left, _ = counted(live.select("node"), "live", n)
            if left in (0, before):
                break
        for end in ("src", "dst"):
            edges = edges.join(live.withColumnRenamed("node", end), end, "left_semi")
        edges = stored(edges.select("src", "dst"), "ways", n)
    return edges


def by_degree(edges: DataFrame, n: int) -> DataFrame:
    """(node, mark), stored: marks are whole numbers in the order of the nodes' numbers of edges."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return stored(degree.orderBy("n", "node").select("node", F.monotonically_increasing_id().alias("mark")), "degrees", n)


def greatest(edges: DataFrame, along: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """(node, to): the node of most edges that leads to a node over `along`, or itself; whether more than ROUNDS edges would change none."""
    degrees = by_degree(edges, n)
    marks, rest = settled(degrees, along, n)
    return stored(marks.join(degrees.select(F.col("node").alias("to"), "mark"), "mark").select("node", "to"), "greatest", n), rest


def around_pivots(edges: DataFrame) -> DataFrame:
    """(node, least) of nodes that lie on a cycle with a pivot: some of them, or none; least is the smallest node of those that share it.

    Every node takes the mark of the greatest node, by its number of edges, that leads to it; one that has
    its own mark is a pivot, and what leads to it over nodes of its mark is on a cycle with it. Work is by node and edge: no pairs.
    """
    n = edges.count()
    of, rest = greatest(edges, edges, n)
    of = of.withColumnRenamed("to", "pivot")
    near = edges.join(of.withColumnsRenamed({"node": "src", "pivot": "a"}), "src").join(shuffled(of.withColumnsRenamed({"node": "dst", "pivot": "b"})), "dst").filter("a = b")
    near = stored(near.select("src", "dst"), "near", n)
    both = of.filter("node = pivot").unionByName(of.join(ends(near), "node", "left_semi").filter("node <> pivot"))
    for along in [turned(near)] if rest else [turned(near), near]:  # at rest a pivot leads to all nodes of its mark, over such nodes
        met, _ = settled(of.join(ends(near), "node", "left_semi").select("node", (F.col("node") == F.col("pivot")).alias("mark")), along, n)
        both = both.filter("node = pivot").unionByName(both.filter("node <> pivot").join(shuffled(met.filter("mark")), "node", "left_semi"))
    both = stored(both, "reached", n)
    least = shuffled(both.groupBy("pivot").agg(F.min("node").alias("least")))
    return shuffled(both.join(least, "pivot").select("node", "least"))


def renamed(edges: DataFrame, to: DataFrame) -> DataFrame:
    """edges (src, dst), stored, with nodes put in place by to (node, least), without those within a node."""
    for end in ("src", "dst"):
        edges = edges.join(to.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("least", end)).drop("least")
    return stored(edges.filter("src <> dst").select("src", "dst").distinct(), "pairs")


def contracted(names: DataFrame, edges: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names (node, component) and edges (src, dst) with nodes put in place by to (node, least), of which none is its own least."""
    names = names.join(to.withColumnRenamed("node", "component"), "component", "left")
    return stored(names.select("node", F.coalesce("least", "component").alias("component")), "components"), renamed(edges, to)


def without_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(node, component) of all nodes of edges (src, dst), the edges between components, and whether no cycle is left among these.

    A component is named by its smallest node. Cycles around pivots are found node by node and in a bounded number of
    rounds, so that a large component becomes one node without pairs.
    """
    edges = stored(edges.select("src", "dst").distinct(), "pairs")
    names = stored(ends(edges).withColumn("component", F.col("node")), "components")
    edges = edges.filter("src <> dst")
    ways = on_ways(edges)
    while not ways.isEmpty():
        to = stored(around_pivots(ways).filter("least <> node"), "merged")
        if to.isEmpty():
            return names, edges, False
        names, edges = contracted(names, edges, to)
        ways = on_ways(renamed(ways, to))
    return names, edges, True


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes of edges (src, dst), and (src, dst) of any two components of which one leads to the other.

    What `without_cycles` leaves is found from the pairs: as soon as two nodes lead to each other they become one.
    A pair is composed of one of exactly k edges and one of at most k, as in `distances`, not of any two.
    """
    return _paired(*without_cycles(edges))


def _paired(names: DataFrame, edges: DataFrame, acyclic: bool) -> tuple[DataFrame, DataFrame]:
    if acyclic:
        return names, distances(edges).select("src", "dst")
    known, k = stored(edges.withColumn("depth", F.lit(1)), "pairs"), 1
    while True:
        pairs = known.select("src", "dst")
        mutual = pairs.join(turned(pairs), ["src", "dst"], "left_semi")
        to = stored(mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).filter("least < node"), "merged")
        if not to.isEmpty():
            names, edges = contracted(names, edges, to)
            known, k = stored(edges.withColumn("depth", F.lit(1)), "pairs"), 1
            continue
        fresh = further(known, k)
        if fresh.isEmpty():
            return names, pairs
        known, k = stored(known.unionByName(fresh), "pairs"), 2 * k


def led_to(starts: DataFrame, on: DataFrame, n: int, closed: DataFrame | None = None) -> DataFrame | None:
    """(start, hub, node): what starts (start, hub) lead to over edges with loops, itself included, without nodes in closed (hub, node) and what comes after; None beyond ROUNDS edges."""
    own, count = F.col("src") == F.col("dst"), 0
    met = stored(starts.select("start", "hub", F.col("start").alias("node"), F.lit(True).alias("new")), "met", n)
    for done in range(0, ROUNDS, PAIR_HOPS):
        met = together(met, PAIR_HOPS * (n + count))
        for _ in range(min(PAIR_HOPS, ROUNDS - done)):
            after = met.join(on, (F.col("node") == F.col("src")) & (F.col("new") | own)).select("start", "hub", F.col("dst").alias("node"), own.alias("old"))
            after = after if closed is None else after.join(closed, ["hub", "node"], "left_anti")
            met = after.groupBy("start", "hub", "node").agg((~F.max("old")).alias("new"))
        met, count, new = counted(met, "met", n + count, "new")
        if not new:
            return met.select("start", "hub", "node")
    return None


def _sums_below(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(component, below): the sizes (component, size), summed up, of what a component leads to over edges (src, dst) without cycles.

    Every node has a hub, the node of most edges that it leads to. What the hub leads to is counted once for
    all nodes that have it; for each of these only what lies beside it is listed, and no pairs through the hub.
    Paths of more than ROUNDS edges are found by doubling, from all pairs.
    """
    n = edges.count()
    size_of = shuffled(sizes.select(F.col("component").alias("node"), "size"))
    hubs = greatest(edges, turned(edges), n)[0].withColumnsRenamed({"node": "start", "to": "hub"})
    used = stored(hubs.filter("start <> hub").select("hub").distinct(), "used", n)
    on = with_loops(edges, n)
    below = led_to(used.select(F.col("hub").alias("start"), "hub"), on, n)
    beside = None if below is None else led_to(hubs.join(used.withColumnRenamed("hub", "start"), "start", "left_anti"), on, n, at_hand(below.select("hub", "node"), below.count()))
    if beside is None:
        pairs = distances(edges).select("src", F.col("dst").alias("node"))
        return pairs.join(size_of, "node").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("below"))
    of_hub = stored(below.join(size_of, "node").groupBy("hub").agg(F.sum("size").alias("whole")), "sums", n)  # with the hub itself
    own = beside.filter("node <> start").join(size_of, "node").groupBy("start").agg(F.sum("size").alias("beside"))
    more = hubs.join(own, "start", "left").join(of_hub, "hub", "left").join(used.select(F.col("hub").alias("start"), F.lit(True).alias("is_hub")), "start", "left")
    more = more.join(size_of.withColumnRenamed("node", "start"), "start")
    whole = of_hub.select(F.col("hub").alias("start"), F.col("whole").alias("own_whole"))
    nothing = F.lit(0).cast("long")
    sums = F.when(F.col("is_hub"), F.col("own_whole") - F.col("size")).otherwise(F.coalesce("beside", nothing) + F.coalesce("whole", nothing))
    return more.join(whole, "start", "left").select(F.col("start").alias("component"), sums.alias("below"))


def reachable_counts(edges: DataFrame) -> DataFrame:
    """node, component, reaches: how many other nodes a node leads to, by the sizes of components."""
    names, between, acyclic = without_cycles(edges)
    if not acyclic:
        names, between = _paired(names, between, acyclic)
    sizes = stored(names.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    if acyclic:
        below = _sums_below(between, sizes)
    else:
        below = between.join(sizes.withColumnRenamed("component", "dst"), "dst").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("below"))
    of = sizes.join(below, "component", "left").select("component", (F.col("size") - 1 + F.coalesce("below", F.lit(0))).alias("reaches"))
    return names.join(of, "component").select("node", "component", "reaches")


def call_tree(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """starts (node), edges (src, dst, at) -> (start, line, depth, src, dst, place, again): the calls below each start in the order of a walk.

    A node's calls, ordered by `at`, stand below the first call of it among those of the least depth; at
    its other calls they are not shown again. place is the list of `at` from the start down, line its
    rank, counted per start from 1.
    """
    edges = stored(edges.select("src", "dst", "at").distinct(), "calls")
    front = starts.select(F.col("node").alias("start"), "node", F.array().cast("array<long>").alias("place")).distinct()
    seen, lines = front.select("start", "node"), None
    for d in range(1, depth + 1):
        calls = front.join(edges, F.col("node") == F.col("src")).select("start", "src", "dst", F.concat("place", F.array(F.col("at").cast("long"))).alias("place"))
        first = calls.groupBy("start", F.col("dst").alias("node")).agg(F.min("place").alias("place")).join(seen, ["start", "node"], "left_anti")
        first = stored(first, "expanded")
        shown = first.select("start", F.col("node").alias("dst"), "place", F.lit(False).alias("again"))
        level = calls.join(shown, ["start", "dst", "place"], "left").select("start", F.lit(d).alias("depth"), "src", "dst", "place", F.coalesce("again", F.lit(True)).alias("again"))
        lines = level if lines is None else lines.unionByName(level)
        front, seen = first, seen.unionByName(first.select("start", "node"))
    w = Window.partitionBy("start").orderBy("place", "dst")
    return lines.withColumn("line", F.row_number().over(w).cast("long"))


def members_of(derived: DataFrame, members: DataFrame) -> DataFrame:
    """derived (base, derived), members (owner, member) -> members of a derived node that its base has, too."""
    own = members.distinct()
    theirs = derived.join(own.withColumnRenamed("owner", "base"), "base")
    return theirs.join(own.withColumnRenamed("owner", "derived"), ["derived", "member"]).select("base", "derived", "member")
