"""Connected components of edges by contraction, as joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, root: str) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node that links reach, for every node of an edge.

    Each round maps every node to the smallest of itself and its neighbours and replaces edges by
    those between what their ends map to; the rounds are few, as at least every second node of a
    component goes. Afterwards the maps are followed back from the last round to the first.
    """
    step, maps = 0, []
    live = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{root}/edges-0")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        near = cut(near, f"{root}/map-{step}")
        maps.append(near)
        left = live.join(near.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = left.join(near.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        step += 1
        live = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{root}/edges-{step}")
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    # a round's targets are nodes of the next round, or roots already
    answer = maps[-1].select("node", F.col("to").alias("component"))
    for i in range(len(maps) - 2, -1, -1):
        later = answer.select(F.col("node").alias("to"), "component")
        answer = maps[i].join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        answer = cut(answer, f"{root}/answer-{i}")
    return answer
