"""Dependency cycles: strongly connected components and one shortest cycle of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .rules import Layers, hard_edges, layer_membership


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(stable_id, component) of nodes on cycles: trim nodes without both kinds of edges, then spread least labels both ways.

    A component is all nodes with the same least node before and behind them; the edges between different
    components go, and what is left goes on until labels and edges agree. Tables are checkpointed
    each round, and every round closes at least the component of the least node that is left.
    """
    live = checkpointed(edges.select("source", "target").distinct())
    done = None
    while True:
        count = live.count()
        while True:  # trim
            ends = live.select(F.col("source").alias("x")).intersect(live.select(F.col("target").alias("x")))
            trimmed = checkpointed(live.join(ends.withColumnRenamed("x", "source"), "source", "left_semi").join(ends.withColumnRenamed("x", "target"), "target", "left_semi"))
            left = trimmed.count()
            live = trimmed
            if left == count:
                break
            count = left
        if not count:
            break
        label = checkpointed(live.select(F.explode(F.array("source", "target")).alias("x")).distinct().select("x", F.col("x").alias("ahead"), F.col("x").alias("back")))
        while True:
            via = live.join(label.select(F.col("x").alias("target"), F.col("ahead")), "target").select(F.col("source").alias("x"), "ahead", F.lit(None).cast("string").alias("back"))
            into = live.join(label.select(F.col("x").alias("source"), F.col("back")), "source").select(F.col("target").alias("x"), F.lit(None).cast("string").alias("ahead"), "back")
            new = checkpointed(label.unionByName(via).unionByName(into).groupBy("x").agg(F.min("ahead").alias("ahead"), F.min("back").alias("back")))
            changed = new.join(label.withColumnsRenamed({"ahead": "a", "back": "b"}), "x").where("ahead != a OR back != b").limit(1).count()
            label = new
            if not changed:
                break
        closed = label.where("ahead = back").select(F.col("x").alias("stable_id"), F.col("ahead").alias("component"))
        done = closed if done is None else done.unionByName(closed)
        rest = label.where("ahead != back")
        a, b = rest.toDF("source", "a1", "b1"), rest.toDF("target", "a2", "b2")
        live = checkpointed(live.join(a, "source").join(b, "target").where("a1 = a2 AND b1 = b2").select("source", "target"))
    if done is None:
        return edges.sparkSession.createDataFrame([], "stable_id string, component string")
    return done


def _girths(step: DataFrame) -> DataFrame:
    """(c, n, first): of each component the number of edges of its shortest cycles, and the least edge on one of them.

    step has one row (c, source, target, edge_id, source_rank, target_rank) for two nodes that an edge joins. A cycle is
    looked for from its node of the highest rank alone, over nodes of lower rank; ranks go by the number of edges,
    so a hub is passed by few searches. A level holds pairs (start, node) at that distance. When a
    level closes cycles of a component, its levels are walked back from the closing edges, which gives all edges on
    its shortest cycles, and the component is left out from then on.
    """
    below = F.col("target_rank") < F.col("start_rank")
    level = step.withColumn("start_rank", F.col("source_rank")).where(below).select("c", F.col("source").alias("start"), "start_rank", F.col("target").alias("at"))
    levels, found = [], []
    while step.limit(1).count():
        level = checkpointed(level)
        levels.append(level)
        back = step.select("c", F.col("source").alias("at"), F.col("target").alias("start"), "edge_id")
        closing = checkpointed(level.join(back, ["c", "start", "at"]).select("c", "start", "at", "edge_id", F.col("at").alias("source"), F.col("start").alias("target")))
        done = closing.select("c").distinct()
        if closing.limit(1).count():
            used, heads = [closing.select("c", "edge_id", "source", "target")], closing.select("c", "start", "at").distinct()
            for k in range(len(levels) - 1, -1, -1):
                # before the first level there is the start itself
                before = levels[k - 1].select("c", "start", F.col("at").alias("source")) if k else heads.select("c", "start", F.col("start").alias("source")).distinct()
                over = before.join(step.select("c", "source", "target", "edge_id"), ["c", "source"]).join(heads.withColumnRenamed("at", "target"), ["c", "start", "target"])
                over = checkpointed(over.select("c", "start", "source", "target", "edge_id"))
                used.append(over.select("c", "edge_id", "source", "target"))
                heads = over.select("c", "start", F.col("source").alias("at")).distinct()
            least = reduce(DataFrame.unionByName, used).groupBy("c").agg(F.min(F.struct("edge_id", "source", "target")).alias("first"))
            found.append(checkpointed(least.withColumn("n", F.lit(len(levels) + 1))))
            step = checkpointed(step.join(done, "c", "left_anti"))
            levels = [x.join(done, "c", "left_anti") for x in levels]
        seen = reduce(DataFrame.unionByName, [x.select("c", "start", "at") for x in levels])
        onward = levels[-1].join(step.select("c", F.col("source").alias("at"), "target", "target_rank"), ["c", "at"]).where(below)
        level = onward.select("c", "start", "start_rank", F.col("target").alias("at")).distinct().join(seen, ["c", "start", "at"], "left_anti")
    return reduce(DataFrame.unionByName, found) if found else step.select("c", F.lit(0).alias("n"), F.struct("edge_id", "source", "target").alias("first"))


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(component, path, edges, cycle_length): of each component its shortest cycle, of any length; edges are (edge_id, source, target).

    Of the shortest ones it is the one that starts with the least edge, and goes on over the least nodes, over the least of
    parallel edges: first in the order of the edges' ids among the first paths of a search from each edge.
    """
    a = checkpointed(strongly_connected(edges).toDF("source", "c"))
    b = a.withColumnRenamed("source", "target")
    inner = checkpointed(edges.select("edge_id", "source", "target").join(a, "source").join(b, ["target", "c"]))
    loops = inner.where("source = target").groupBy("c").agg(F.min(F.struct("edge_id", "source", "target")).alias("first"))
    rest = inner.join(loops.select("c"), "c", "left_anti").groupBy("c", "source", "target").agg(F.min("edge_id").alias("edge_id"))
    rest = checkpointed(rest)
    degree = rest.select(F.explode(F.array("source", "target")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    rank = degree.select("x", F.struct("d", "x").alias("rank"))
    step = checkpointed(rest.join(rank.toDF("source", "source_rank"), "source").join(rank.toDF("target", "target_rank"), "target"))
    first = loops.withColumn("n", F.lit(1)).unionByName(_girths(step))
    # from the least edge back to its source: each node once, with its first path
    walk = first.select("c", "n", F.col("first.source").alias("goal"), F.col("first.target").alias("at"), F.array("first.source", "first.target").alias("nodes"), F.array("first.edge_id").alias("ids"))
    walk = checkpointed(walk)
    cycles, seen = [walk.where("at = goal")], walk.select("c", "at")
    walk = walk.where("at != goal")
    while walk.limit(1).count():
        onward = walk.join(step.select("c", F.col("source").alias("at"), "target", "edge_id"), ["c", "at"])
        onward = onward.select("c", "n", "goal", F.col("target").alias("at"), F.concat("nodes", F.array("target")).alias("nodes"), F.concat("ids", F.array("edge_id")).alias("ids"))
        best = onward.groupBy("c", "n", "goal", "at").agg(F.min(F.struct("nodes", "ids")).alias("m")).select("c", "n", "goal", "at", "m.nodes", "m.ids")
        best = checkpointed(best.join(seen, ["c", "at"], "left_anti").select(*walk.columns))
        hit = best.where("at = goal")
        cycles.append(hit)
        seen = seen.unionByName(best.select("c", "at"))
        walk = best.join(hit.select("c"), "c", "left_anti")
    out = reduce(DataFrame.unionByName, cycles)
    return out.select(F.col("c").alias("component"), F.array_join("nodes", ",").alias("path"), F.array_join("ids", ",").alias("edges"), F.col("n").cast("long").alias("cycle_length"))


def detect_cycles(nodes: DataFrame, edges: DataFrame, layers: Layers, kinds: list[str]) -> DataFrame:
    """shortest_cycles over the hard edges between nodes that belong to exactly one layer."""
    own = layer_membership(nodes, layers).where("state = 'Assigned'").select("stable_id")
    hard = hard_edges(edges, kinds)
    for end in ("source", "target"):
        hard = hard.join(own.withColumnRenamed("stable_id", end), end, "left_semi")
    return shortest_cycles(hard.select("edge_id", "source", "target"))
